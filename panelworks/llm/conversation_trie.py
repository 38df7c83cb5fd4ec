"""The prefix trie of conversations, by van Emde Boas recursion.

Sequences of turns are cut at half the depth, again and again: at the highest power of two first, then halves of halves. A cut
prefix is named by the name of the prefix before its last half and the digest of that half, so equal prefixes have one
name, and everything below a cut is a forest under its name that needs nothing from above. All upper tries and lower forests
are built at once: which nodes there are and how many sequences pass is one grouping by name. Halves of up to BLOCK turns are
named within a task, longer ones by joins of block digests, a round for each doubling, so no task holds an endless conversation.

Totals are grafted upward from the lowest cuts: in runs of RUN depths each node gives to its ancestors in the run; then, for
each doubling, the roots of the lower forests give their totals to their ancestors in the upper trie. A root gives through one
of its members only, so the work is the number of turns times the number of doublings. Names are 128-bit digests.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import HOT_ROWS, SHARE, hot_keys, skew_join, written

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose first turns come from the first one of their family, and the numbers of turns that may come.
FAMILY, MOST_HEAD = 20, 4
#: Turns that are named within a task; depths in which totals are given directly. Powers of two.
BLOCK, RUN = 1024, 8
#: Ids of a node's ends in one piece of text.
ENDS = 4096
ROOT = bytes(16)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _symbol(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


# order and rebuilding


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), symbol and words of each turn of a table (conv_id, turn, role, text), in order of turn, null first,
    then role and text. Rows are sorted by ranges, so a conversation may go over many tasks; what lies in the ranges before
    is added for the one conversation that can go on into each range."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id is not null")
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ranges = clean.repartitionByRange(*by).sortWithinPartitions(*by)
    light = ranges.select("conv_id", _symbol(F.col("role"), F.col("text")).alias("symbol"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            ids = np.asarray(batch["conv_id"])
            if not len(ids):
                continue
            first = np.flatnonzero(np.diff(ids, prepend=ids[0]) != 0)
            start = np.zeros(len(ids), np.int64)
            start[first] = first
            at = np.arange(len(ids)) - np.maximum.accumulate(start)
            own = len(ids) if not len(first) else int(first[0])
            if ids[0] == current:
                at[:own] += seen
            seen, current = int(at[-1]) + 1, ids[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["conv_id", "symbol", "words", "part", "at"])

    placed = written(light.mapInArrow(run, "conv_id long, symbol binary, words long, part int, at long"), "turn-places")
    held = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = held.withColumn("before", F.sum("held").over(earlier)).filter("before is not null").drop("held")
    # at most one conversation goes on into each range: a row for each partition of the sort
    out = placed.join(F.broadcast(before), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "symbol", "words")


def family_heads(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns, rebuilt: (conv_id, length) and (conv_id, depth from 1, symbol, words, length).

    Conversation c starts with the first h turns of conversation c - c % FAMILY (all if there are fewer, none if it is not
    there), then has its own after its first h; h = crc32 of the decimal c, % MOST_HEAD. % is the remainder that SQL gives.
    """
    ordered = written(ordered, "ordered-turns")
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD
    sizes = written(ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes").withColumns({"base": base, "h": h})
    first = sizes.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    got = F.least("h", F.coalesce("base_n", F.lit(0)))
    told = sizes.join(first, "base", "left").withColumn("got", got)
    told = written(told.withColumn("length", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = ordered.filter((F.col("conv_id") == base) & (F.col("pos") < MOST_HEAD)).select(F.col("conv_id").alias("base"), "pos", "symbol", "words")
    from_base = told.join(heads, "base").filter("pos < got").select("conv_id", (F.col("pos") + 1).alias("depth"), "symbol", "words", "length")
    hot = [r[0] for r in told.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(SHARE).select("conv_id").collect()]
    kept = ordered.withColumn("h", h).filter("pos >= h")
    own = skew_join(kept, told.select("conv_id", "got", "length"), "conv_id", hot=hot, deal=F.col("pos"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("got") + 1).alias("depth"), "symbol", "words", "length")
    return told.select("conv_id", "length"), from_base.unionByName(own)


# names


def block_names(digests: DataFrame) -> DataFrame:
    """conv_id, block, name: the name of the prefix before each block, from (conv_id, block, digest) of the whole blocks.

    The blocks of a prefix are cut as its depth's binary digits say: the largest half first. Digests of halves are made
    bottom up, names top down.
    """
    spark = digests.sparkSession
    digests = written(digests, "block-digests")
    last = digests.agg(F.max("block")).first()[0]
    if last is None:
        return spark.createDataFrame([], "conv_id long, block long, name binary")
    short = lambda *parts: F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)
    halves = [digests]
    while (last + 1) >> len(halves):
        pairs = halves[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("two"))
        whole = pairs.filter(F.size("two") == 2).select("conv_id", "block", short(F.col("two")[0]["digest"], F.col("two")[1]["digest"]).alias("digest"))
        halves.append(written(whole, "half-digests"))
    names = digests.select("conv_id", (F.col("block") + 1).alias("block"), F.lit(ROOT).alias("name"))
    for j in reversed(range(len(halves))):
        half = halves[j].withColumnRenamed("block", "upper")
        place = F.shiftright("block", j)
        upper = F.when(place % 2 == 1, place - 1)
        found = names.withColumn("upper", upper).join(half, ["conv_id", "upper"], "left")
        names = written(found.select("conv_id", "block", F.when(F.col("upper").isNotNull(), short("name", "digest")).otherwise(F.col("name")).alias("name")), "prefix-names")
    return names


def names_below(symbols: list[bytes], before: bytes, after: bytes | None) -> list[bytes]:
    """Names of the prefixes of 0 to len(symbols) turns under a prefix; `after` is that of a whole block."""
    digests = [symbols]
    while len(digests[-1]) > 1:
        row = digests[-1]
        digests.append([_digest(row[k], row[k + 1]) for k in range(0, len(row) - 1, 2)])
    names = [before] * (len(symbols) + 1)

    def cut(low: int, level: int) -> None:
        """Names within 1 << level turns after `low`, of which the name is known."""
        if not level:
            return
        level -= 1
        middle = low + (1 << level)
        if middle < len(names):
            names[middle] = _digest(names[low], digests[level][low >> level])
            cut(middle, level)
        cut(low, level)

    cut(0, len(symbols).bit_length())
    if after is not None:
        names[-1] = after
    return names


PREFIX = "conv_id long, depth long, name binary, up array<binary>, words long, length long"


def prefixes(sequences: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row of PREFIX for each prefix of each sequence, the empty one too; up: names of the ancestors from the parent on, back to the
    start of the run of RUN depths, or the parent alone where a run starts."""
    key = F.floor((F.col("depth") - 1) / block)
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("depth", "symbol"))), lambda x: F.hex(x["symbol"]))), 256)), 1, 16)
    whole = turns.filter(F.col("length") >= block).groupBy("conv_id", key.alias("block")).agg(digest.alias("digest"), F.count(F.lit(1)).alias("n"))
    named = block_names(whole.filter(F.col("n") == block).drop("n"))
    blocks = turns.groupBy("conv_id", key.alias("block")).agg(F.array_sort(F.collect_list(F.struct("depth", "symbol", "words"))).alias("turns"), F.first("length").alias("length"))
    before, after = named.withColumnRenamed("name", "before"), named.select("conv_id", (F.col("block") - 1).alias("block"), F.col("name").alias("after"))
    told = blocks.join(before, ["conv_id", "block"], "left").join(after, ["conv_id", "block"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"conv_id": [], "depth": [], "name": [], "up": [], "words": [], "length": []}
            for row in batch.to_pylist():
                names = names_below([t["symbol"] for t in row["turns"]], row["before"] or ROOT, row["after"])
                for i, turn in enumerate(row["turns"], 1):
                    out["up"].append(names[i - (turn["depth"] % RUN or 1) : i][::-1])
                    out["depth"].append(turn["depth"])
                    out["words"].append(turn["words"])
                out["name"] += names[1:]
                out["conv_id"] += [row["conv_id"]] * len(row["turns"])
                out["length"] += [row["length"]] * len(row["turns"])
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(out, types)], list(out))

    roots = sequences.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), F.array().cast("array<binary>").alias("up"), F.lit(0).cast("long").alias("words"), "length")
    return told.mapInArrow(run, PREFIX).unionByName(roots)


# totals


def _grafted(paths: DataFrame, totals: DataFrame, deepest: int) -> DataFrame:
    """name, n_leaves, saved: what the roots of lower forests give to their ancestors, for all cuts of more than RUN depths.

    totals: name, conv_id, depth, n_leaves, saved of each node within its run.
    """
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved")]
    given = []
    level = RUN.bit_length() - 1
    while 1 << level <= deepest:
        half = 1 << level
        is_cut = F.col("depth") % (2 * half) == half
        known = functools.reduce(DataFrame.unionByName, [d.withColumn("conv_id", F.lit(None).cast("long")) for d in given], totals)
        cuts = known.filter(is_cut).groupBy("name").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("cut"), *sums).drop("name")
        chunk = F.explode(F.sequence(F.floor((F.col("cut") - half) / BLOCK), F.floor((F.col("cut") - 1) / BLOCK)))  # so that a key has BLOCK rows at most
        cut = F.col("depth") - F.col("depth") % half + half
        upper = paths.filter((F.col("depth") % (2 * half) < half) & (cut <= F.col("length"))).select("conv_id", "depth", "name", cut.alias("cut"), F.floor(F.col("depth") / BLOCK).alias("chunk"))
        gifts = upper.join(cuts.withColumn("chunk", chunk), ["conv_id", "cut", "chunk"]).groupBy("name").agg(F.max("depth").alias("depth"), *sums)
        given.append(written(gifts, "grafted"))
        level += 1
    return functools.reduce(DataFrame.unionByName, given, totals.drop("conv_id").limit(0)).drop("depth")


def end_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of rows (name, conv_id): SHA-256 of a name's decimal ids, ascending, comma between them.

    Ids are sorted by ranges and joined in pieces of ENDS, so that the one task that must hash a name's text from its start to
    its end reads a row for each ENDS of its ids, in order, and holds one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch["name"].to_pylist(), batch["conv_id"].to_pylist()
            first = [k for k in range(len(ids)) if k == 0 or names[k] != names[k - 1]]
            starts = [k for a, b in zip(first, [*first[1:], len(ids)]) for k in range(a, b, ENDS)]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_pydict({"name": pa.array([names[k] for k in starts], pa.binary()), "first": pa.array([ids[k] for k in starts], pa.int64()), "text": pa.array(texts, pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for own, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if own != name:
                    if name is not None:
                        done.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _digest_rows(done)
        if name is not None:
            yield _digest_rows([(name, state.hexdigest())])

    cut = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, "name binary, first long, text string")
    return cut.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"name": pa.array([r[0] for r in rows], pa.binary()), "ends_sha256": pa.array([r[1] for r in rows], pa.string())})


def build_trie(sequences: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: name, parent_name, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    sequences: (conv_id, length), each once; turns: (conv_id, depth 1 to length, symbol of 16 bytes, words, length). A node is a distinct
    sequence of symbols, the root the empty one. conv_id: the smallest member; n_convs: members; n_leaves: childless nodes of its
    subtree, itself included; saved_tokens: (n_convs - 1) * words, summed over its subtree; ends_sha256: of the members that end
    there. No sequences give no nodes; sequences without turns give the root.
    """
    paths = written(prefixes(sequences, turns, block), "prefixes")
    nodes = paths.groupBy("name").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.first("up").alias("up"))
    nodes = written(nodes.withColumn("parent_name", F.get("up", F.lit(0))), "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_name").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    told = nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = told.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    told = written(told.drop("words"), "trie-counts")
    in_run = F.when(F.col("depth") % RUN > 0, F.col("up")).otherwise(F.array().cast("array<binary>"))
    gifts = told.select(F.explode(in_run).alias("name"), "n_leaves", "saved").groupBy("name").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    totals = written(told.join(gifts, "name", "left").select("name", "conv_id", "depth", plus("n_leaves", "more_leaves"), plus("saved", "more")), "run-totals")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    long_paths = paths.filter(F.col("length") >= RUN).select("conv_id", "depth", "name", "length")
    grafted = totals.select("name", "n_leaves", "saved").unionByName(_grafted(long_paths, totals, deepest))
    sums = grafted.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = end_digests(paths.filter("depth = length").select("name", "conv_id"))
    owners = nodes.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    light = told.drop("up", "n_leaves", "saved")
    shown = skew_join(light.filter("depth > 0"), owners, "parent_name", hot=hot_keys(light, "parent_name"), deal=F.xxhash64("name"))
    shown = shown.unionByName(light.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = shown.join(sums, "name").join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("name", "parent_name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """build_trie() of the rebuilt conversations (family_heads) of a table (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then role and text; every row is a turn, repeated ones too. Null role and text are
    empty; rows without conv_id are in no conversation. A turn is equal to another if role and text are. Further columns are
    not read. An empty table gives an empty table. Words are runs of anything but space and control white space.
    """
    return build_trie(*family_heads(ordered_turns(turns)), block)
