"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words. Equal texts are one class. Classes that share a band of MinHash values are
compared value by value, some at a time: given m equal ones of n, similarity has the posterior Beta(m + 1, n - m + 1),
and a pair goes as soon as its probability of reaching the threshold is below the tolerance. The pairs left join
classes to clusters; within a cluster the shingle sets themselves are compared, so every link that is told is exact.

A bucket of many texts is dealt out in blocks. Each block is connected within itself by edges, fewer than it has rows;
between blocks, classes are held against each other and only rows that are in no common class yet are compared. A
cluster is verified in pairs of blocks, as every link in it counts; a task returns a count of links for each row and at
most one edge for each class of its blocks, never the pairs. Texts are told apart by 128-bit hashes of their words,
shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import HOT_ROWS, SHARE, hot_keys, skew_join, strings, text_spans, with_fields, written

SHINGLE_WORDS = 5
#: Similarity that links two texts, as a fraction: LINK_OF[0] / LINK_OF[1].
LINK_OF = (4, 5)
HASHES = 96
#: The share of pairs at the threshold that must meet in a band.
FOUND = 0.999
#: Hashes compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 8, 1e-6
BUCKET_BLOCK, CLUSTER_BLOCK, BLOCK_BYTES = 1024, 128, 16 << 20



def band_sizes(threshold: float, hashes: int = HASHES, found: float = FOUND) -> tuple[int, int]:
    """Bands and values a band: the longest bands with which at least `found` of the pairs at the threshold meet in one."""
    fitting = [r for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= found]
    rows = max(fitting, default=1)
    return hashes // rows, rows


_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Multipliers and shifts of the MinHash functions, by a rule.
_FACTORS = _mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_SHIFTS = _mixed(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * _ODD)


def least_equal(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... hashes: the fewest equal ones with which a pair may still reach the threshold."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(values: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each text: the words with single spaces; of all: hashes of their shingles, and how many each text has."""
    flat, counts, texts = [], [], []
    for text in values:
        own = text.encode().split()
        flat += own
        counts.append(len(own))
        texts.append(b" ".join(own))
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(x, len(number)) for x in flat), np.int64, len(flat))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[words]
    n_words = np.array(counts, np.int64)
    of = np.maximum(n_words - SHINGLE_WORDS + 1, 0)
    ends = np.cumsum(n_words)
    first = np.repeat(ends - n_words - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
    mixed = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE_WORDS):
        mixed = mixed * _ODD + hashes[first + k]
    return texts, _mixed(mixed), of


SKETCH = "doc_id long, text_key binary, n_shingles long, sketch binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_spans(batch["text"]):
            texts, hashes, of = shingles(strings(batch["text"].slice(a, b - a)))
            some = np.flatnonzero(of)
            values = np.zeros((len(some), HASHES), np.uint32)
            if len(some):
                starts = (np.cumsum(of) - of)[some]
                for k in range(HASHES):
                    values[:, k] = np.minimum.reduceat(((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
            sketch: list = [None] * len(texts)
            for k, row in zip(some.tolist(), values, strict=True):
                sketch[k] = row.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()), pa.array(of, pa.int64()), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "sketch"],
            )


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of neighbouring rows with one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = _changes(batch, key)
        if held and not _changes(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]), key)[1]:
            new[0] = False
        starts = np.flatnonzero(new)
        if len(starts):
            last = int(starts[-1])
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(rows: pa.RecordBatch | pa.Table, key: list[str]) -> np.ndarray:
    """Whether each row's key differs from the one before; the first row's does."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in key:
        of = pa.chunked_array([rows[c]]) if isinstance(rows, pa.RecordBatch) else rows[c]
        new[1:] |= pc.not_equal(of.slice(1), of.slice(0, len(of) - 1)).to_numpy(zero_copy_only=False) if len(of) > 1 else False
    return new


def _sketch_table(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), HASHES)


def _alike(values: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int]) -> np.ndarray:
    """Which of the pairs (i, j) of rows stay after all steps of the comparison."""
    at, equal = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(need):
        cols = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (values[i[at], cols] == values[j[at], cols]).sum(axis=1)
        alive = equal >= least
        at, equal = at[alive], equal[alive]
        if not len(at):
            break
    return at


def _forest(values: np.ndarray, need: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a class, more rows of it): each row is compared only with those that no other has brought in yet."""
    left = np.arange(len(values))
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            x = todo.pop()
            at = _alike(values, np.full(len(left), x), left, need)
            if len(at):
                yield first, left[at]
                todo += left[at].tolist()
                left = np.delete(left, at)


SMALL, PAIRS = 8, 1 << 17


def _edge_batch(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _prune(threshold: float):
    """Edges that connect the rows of each block of a bucket as far as pairs within it stay."""
    need = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["bucket", "block"]):
            starts = np.flatnonzero(_changes(rows, ["bucket", "block"]))
            sizes = np.diff(starts, append=len(rows))
            nodes, values = rows["node"].to_pylist(), _sketch_table(rows["sketch"])
            a, b = [], []
            pairs = [(starts[sizes == n] + x, starts[sizes == n] + y) for n in range(2, SMALL + 1) for x, y in combinations(range(n), 2)]
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            for at in range(0, len(i), PAIRS):  # all pairs of small groups, many groups at once
                stay = at + _alike(values, i[at : at + PAIRS], j[at : at + PAIRS], need)
                a += i[stay].tolist()
                b += j[stay].tolist()
            for start, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                for x, brought in _forest(values[start : start + n], need):
                    a += [start + x] * len(brought)
                    b += (start + brought).tolist()
            yield _edge_batch([nodes[x] for x in a], [nodes[x] for x in b])

    return run


def _bridge(threshold: float):
    """Edges between the labels of each pair of blocks: every row of the first block against every row of the second."""
    need = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, PAIR):
            bounds = [*np.flatnonzero(_changes(rows, PAIR)).tolist(), len(rows)]
            labels, values = np.array(rows["label"].to_pylist(), object), _sketch_table(rows["sketch"])
            first, second = rows["first"].to_numpy(), rows["second"].to_numpy()
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                joined: set[tuple] = set()
                theirs = lo + np.flatnonzero(second[lo:hi])
                for x in (lo + np.flatnonzero(first[lo:hi])).tolist():
                    other = theirs[labels[theirs] != labels[x]]
                    hit = other[_alike(values, np.full(len(other), x), other, need)]
                    joined |= {(labels[x], y) for y in set(labels[hit].tolist())}
                a += [x for x, _ in joined]
                b += [y for _, y in joined]
            yield _edge_batch(a, b)

    return run


PAIR = ["bucket", "kind", "x", "y"]


def _across_blocks(large: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(label, new) of labels that are connected, by pairs in buckets of several blocks, each of which is connected within itself already.

    First one row of each label is held against those of the other labels; what is one class then, is not compared again. Only
    the rows beside the most frequent label of their bucket go on, against each other and against the rows of that label, in
    pairs of blocks. So a bucket of very many copies costs as many comparisons as it has rows, for each label that it holds.
    """
    named = written(_labelled(large, labels), "bucket-labels")
    reps = named.groupBy("bucket", "label").agg(F.min_by("sketch", "node").alias("sketch"))
    of_bucket = reps.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_odd"))
    own = written(_paired(reps.join(of_bucket, "bucket").withColumns({"node": F.col("label"), "odd": F.lit(True), "n_main": F.lit(0)})).mapInArrow(_bridge(threshold), "a binary, b binary"), "bridges")
    newer = written(components(own).withColumnsRenamed({"node": "label", "component": "new"}), "bridged")
    named = written(named.join(newer, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new"), "bucket-labels")
    counts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_odd")).filter("n_odd > 0")
    told = skew_join(named, main, "bucket").withColumn("odd", F.col("label") != F.col("main"))
    later = _paired(told).mapInArrow(_bridge(threshold), "a binary, b binary")
    return components(later.unionByName(newer.select(F.col("new").alias("a"), F.col("label").alias("b")))).withColumnsRenamed({"node": "label", "component": "new"})


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _paired(rows: DataFrame) -> DataFrame:
    """Each odd row once for every block of odd and of main rows, each main row once for every block of odd ones."""
    blocks = {n: F.ceil(F.col(f"n_{n}") / BUCKET_BLOCK).cast("int") for n in ("odd", "main")}
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("odd"), blocks["odd"]).otherwise(blocks["main"])).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    row = lambda kind, x, y, first, second: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), first.alias("first"), second.alias("second"))
    yes, no, at = F.lit(True), F.lit(False), F.col("at")
    of_odd = F.concat(
        F.transform(upto(blocks["main"]), lambda k: row(0, k, at, no, yes)),
        F.transform(upto(blocks["odd"]), lambda k: row(1, F.least(at, k), F.greatest(at, k), at <= k, at >= k)),
    )
    of_main = F.transform(upto(blocks["odd"]), lambda k: row(0, at, k, yes, no))
    dealt = rows.withColumn("at", mine).withColumn("_p", F.explode(F.when(F.col("odd"), of_odd).otherwise(of_main)))
    out = dealt.select("bucket", "label", "node", "sketch", "_p.*")
    return out.repartition(*PAIR).sortWithinPartitions(*PAIR, "node")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its connected component; linked is symmetric."""
    root = np.full(len(linked), -1, np.int64)
    for k in range(len(linked)):
        if root[k] < 0:
            new = np.zeros(len(linked), bool)
            new[k] = True
            seen = new.copy()
            while new.any():
                new = linked[new].any(axis=0) & ~seen
                seen |= new
            root[seen] = k
    return root


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    number = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    keep = order[often[column[order]] > 1]
    column, number = column[keep], number[keep]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    at = 0
    while at < len(column):  # some thousand shingles at a time
        to = int(np.searchsorted(column, column[at] + 4096, side="left"))
        part = np.zeros((len(sets), int(column[to - 1] - column[at]) + 1), np.float32)
        part[number[at:to], column[at:to] - column[at]] = 1
        shared += part @ part.T
        at = to
    return shared.astype(np.int64)


def _verify(link_of: tuple[int, int]):
    """For each pair of blocks of a cluster: links of each row, and edges that connect what one block has not connected itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["cluster", "lo", "hi"]):
            bounds = [*np.flatnonzero(_changes(rows, ["cluster", "lo", "hi"])).tolist(), len(rows)]
            nodes, sets = rows["node"].to_pylist(), rows["shingles"].to_pylist()
            first, second = rows["first"].to_numpy(), rows["second"].to_numpy()
            node, n_links, root = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                lo, hi = first[a:b], second[a:b]
                own = [np.frombuffer(x, "<u8") for x in sets[a:b]]
                size, shared = np.array([len(x) for x in own], np.int64), _shared(own)
                linked = shared * link_of[1] >= (size[:, None] + size[None, :] - shared) * link_of[0]
                np.fill_diagonal(linked, False)
                across = linked & ((lo[:, None] & hi[None, :]) | (hi[:, None] & lo[None, :]))
                node += nodes[a:b]
                n_links += across.sum(axis=1).tolist()
                within = np.where(lo & hi, _roots(linked), -1)
                if not (lo & hi).all():  # two blocks: roots of each, and those that a link across connects
                    within = np.full(b - a, -1)
                    of_block = _roots(linked & ~across)
                    between = np.zeros_like(linked)
                    i, j = np.nonzero(across)
                    between[of_block[i], of_block[j]] = True
                    joined = _roots(between | between.T)
                    some = np.flatnonzero(of_block == np.arange(b - a))
                    within[some] = joined[some]
                root += [None if r < 0 or r == k else nodes[a + r] for k, r in enumerate(within.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(n_links, pa.int64()), pa.array(root, pa.binary())], ["node", "n_links", "root"])

    return run


def _cluster_pairs(sets: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that it takes part in. A block has a 64th of its cluster, at least CLUSTER_BLOCK
    and at most 1,024 rows, and about BLOCK_BYTES of shingles at most."""
    of_rows = F.col("size") / F.least(F.greatest(F.col("size") / 64, F.lit(CLUSTER_BLOCK)), F.lit(1024))
    blocks = F.greatest(F.ceil(of_rows), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    dealt = sets.withColumn("at", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = dealt.select("cluster", F.least("at", "to").alias("lo"), F.greatest("at", "to").alias("hi"), (F.col("at") <= F.col("to")).alias("first"), (F.col("at") >= F.col("to")).alias("second"), "node", "shingles")
    return out.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node that each is connected to.

    Every node is first hung below its smallest neighbour, if that is smaller than itself; only the nodes that others hang
    below, and what connects them, go into the rounds that follow. There labels pass along edges and then jump to their
    label's label; each round is written to the shared folder.
    """
    pairs = written(edges.filter("a <> b").select(F.least("a", "b").alias("top"), F.greatest("a", "b").alias("below")).distinct(), "edges")
    hung = written(pairs.groupBy("below").agg(F.min("top").alias("first")), "hung")
    tops = written(pairs.select("top").distinct(), "tops")
    beside = skew_join(pairs, hung, "below").filter("top <> first").select(F.col("first").alias("a"), F.col("top").alias("b"))
    above = hung.join(tops.withColumnRenamed("top", "below"), "below").select(F.col("first").alias("a"), F.col("below").alias("b"))
    core = _labels(beside.unionByName(above)).withColumnsRenamed({"node": "first", "label": "component"})
    told = skew_join(hung, core, "first", "left").select(F.col("below").alias("node"), F.coalesce("component", "first").alias("component"))
    roots = tops.withColumnRenamed("top", "below").join(hung, "below", "left_anti").withColumnRenamed("below", "first").join(core, "first", "left")
    return told.unionByName(roots.select(F.col("first").alias("node"), F.coalesce("component", "first").alias("component")))


def _labels(edges: DataFrame) -> DataFrame:
    both = written(edges.union(edges.select("b", "a")).distinct(), "core")
    if not both.limit(1).count():
        return both.withColumnsRenamed({"a": "node", "b": "label"})  # no rows
    hubs = hot_keys(both, "b")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = skew_join(both, labels.withColumnRenamed("node", "b"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        passed = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new")), "passed")
        jump = passed.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = written(skew_join(passed, jump, "new", "left").select("node", "label", F.least("new", "far").alias("new")), "labels")
        changed = after.filter("label <> new").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, link_of: tuple[int, int] = LINK_OF) -> DataFrame:
    """doc_id, text_key, text_id, n_links, class_key, class_id for every row of docs.

    text_key tells texts of the same words apart from others; text_id: the smallest doc_id with the same words. n_links:
    other texts at least as similar as link_of (0.8). class_id: the smallest doc_id that links connect it to. Texts under
    five words, empty and null ones have no shingles: they are equal or not, and have no links. Rows of one doc_id stay,
    whatever their texts; a text of which no row has a doc_id is not searched, and its ids are null. Other columns of docs
    are not read. An empty table gives an empty one.
    """
    threshold = link_of[0] / link_of[1]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(_sketches, SKETCH), "sketches")
    one = F.min_by(F.struct("n_shingles", "sketch"), F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    classes = written(rows.groupBy(F.col("text_key").alias("node")).agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n_rows"), one.alias("s")).select("node", "text_id", "n_rows", "s.*"), "classes")

    searched = classes.filter("n_shingles > 0 and text_id is not null")
    bands, band_rows = band_sizes(link_of[0] / link_of[1])
    width = 4 * band_rows
    bucket = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.col("sketch").substr(k * width + 1, F.lit(width))))).alias("bucket")
    banded = searched.select("node", bucket)
    sizes = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    totals = classes.agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("texts")).first()
    large_key = lambda df, key, n, total: [r[0] for r in df.filter((F.col(n) > HOT_ROWS) & (F.col(n) * SHARE > (total or 0))).select(key).collect()]
    members = skew_join(banded, sizes, "bucket", hot=large_key(sizes, "bucket", "size", totals.texts * bands)).join(searched.select("node", "sketch"), "node")
    several = bool(sizes.filter(F.col("size") > BUCKET_BLOCK).limit(1).count())
    if several:
        members = written(members, "members")
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    near = dealt.mapInArrow(_prune(threshold), "a binary, b binary")
    cluster = components(near)
    if several:
        cluster = written(cluster, "within-blocks")
        bridged = written(_across_blocks(members.filter(F.col("size") > BUCKET_BLOCK), cluster, threshold), "across-blocks")
        single = bridged.select(F.col("label").alias("node"), F.col("new").alias("component")).join(cluster, "node", "left_anti")
        moved = skew_join(cluster.withColumnRenamed("component", "label"), bridged, "label", "left").select("node", F.coalesce("new", "label").alias("component"))
        cluster = moved.unionByName(single)

    clustered = written(cluster.join(searched.select("node", "text_id", "n_shingles"), "node").withColumnRenamed("component", "cluster"), "clusters")
    of_cluster = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("total"))
    wanted = skew_join(clustered, of_cluster, "cluster").drop("n_shingles")

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_spans(batch["text"]):
                part = batch.slice(a, b - a)
                texts, hashes, of = shingles(strings(part["text"]))
                ends = np.cumsum(of)
                mine = [xxhash.xxh3_128_digest(x) == k for x, k in zip(texts, part["node"].to_pylist(), strict=True)]
                sets = [np.unique(hashes[e - n : e]).astype("<u8").tobytes() if m else None for e, n, m in zip(ends, of, mine, strict=True)]
                kept = part.append_column("shingles", pa.array(sets, pa.binary())).filter(pa.array(mine))
                yield kept.select(["node", "cluster", "size", "total", "shingles"])

    found = texts.join(wanted.hint("merge"), texts["doc_id"] == wanted["text_id"]).select("node", "cluster", "size", "total", "text")
    sets = written(found.mapInArrow(own_sets, "node binary, cluster binary, size long, total long, shingles binary"), "shingles").dropDuplicates(["node"])
    checked = written(_cluster_pairs(sets).mapInArrow(_verify(link_of), "node binary, n_links long, root binary"), "links")
    joined = written(components(checked.filter(F.col("root").isNotNull()).select(F.col("root").alias("a"), F.col("node").alias("b"))).join(searched.select("node", "text_id"), "node"), "classes-of")
    least = joined.groupBy("component").agg(F.min("text_id").alias("class_id"))
    links = checked.groupBy("node").agg(F.sum("n_links").alias("n_links")).join(skew_join(joined, least, "component").select("node", F.col("component").alias("class_key"), "class_id"), "node", "left")
    of_class = classes.select("node", "text_id").join(links, "node", "left").withColumnRenamed("node", "text_key")
    out = skew_join(rows.select("doc_id", "text_key"), of_class, "text_key", hot=large_key(classes, "node", "n_rows", totals.rows))
    return out.select("doc_id", "text_key", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_key", "text_key").alias("class_key"), F.coalesce("class_id", "text_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, link_of: tuple[int, int] = LINK_OF) -> DataFrame:
    """All columns of docs; one row of each class of near_duplicates() stays: that of the smallest doc_id.

    Of several texts or rows with that doc_id in a class, the text with the smallest key and one of its rows stay, so rows
    of one doc_id with texts of different classes all stay. A null doc_id comes after all others; equal texts of which no
    row has a doc_id are a class of their own. Null and empty texts are texts without words, which are all equal.
    """
    told = near_duplicates(docs, link_of)
    same = told.groupBy("class_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_same"))
    stays = same.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n_same")).alias("s")).select("s.*")
    row = F.xxhash64("doc_id", "text_key").alias("_row")
    stays = written(stays.select(row, F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_same"), "stays")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_spans(batch[names[at]]):
                part = batch.slice(a, b - a)
                key = [xxhash.xxh3_128_digest(b" ".join(x.encode().split())) for x in strings(part[names[at]])]
                yield part.append_column("text_key", pa.array(key, pa.binary()))

    plain = docs.toDF(*names)
    keyed = plain.mapInArrow(keys, with_fields(plain.schema, "text_key binary")).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    keyed = keyed.select(*names, "doc_id", "text_key", row)
    hot = [r[0] for r in stays.filter(F.col("n_same") > HOT_ROWS).orderBy(F.desc("n_same")).limit(SHARE).select("_row").collect()]
    left = skew_join(keyed, stays, "_row", hot=hot, deal=F.monotonically_increasing_id()).filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    once = left.filter("n_same = 1").unionByName(left.filter("n_same > 1").dropDuplicates(["_row", "doc_id", "text_key"]))
    return once.select(*names).toDF(*docs.columns)
