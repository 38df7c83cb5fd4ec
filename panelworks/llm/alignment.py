"""Alignment of two tokenizers over a corpus, with counts of the id pairs that they link.

The tokens of both tokenizers cover the same bytes of a text. Tokens whose byte ranges overlap are linked; places where both
end a token cut a text into groups. For each pair of ids that is linked anywhere, the documents that hold it are counted:

1. Documents are dealt to batches of about BATCH bytes, a longer one alone, encoded, and written as ids. Each batch is
   aligned and gives, for each of BUCKETS buckets of the first tokenizer's ids, its distinct pairs and how many of its
   documents hold each.
2. The distinct pairs of a bucket, merged as a tree, get a minimal perfect hash: levels of bits in which a pair that is alone
   in its place owns it and the others go on to the next level; the rank of its bit is a pair's number. The pairs are kept
   in this order, so that each look-up is verified.
3. Batches add their counts into dense vectors under these numbers, FAN batches a vector, and the vectors are summed as a
   tree. As a bucket holds all pairs of its first ids, it knows the highest count of each.
4. Every batch looks up the counts of its pairs, is aligned again from its ids, and gives a row for each document.

A bucket has at most (ids of A / BUCKETS) x (ids of B) pairs, 6.3 million for vocabularies of 50,257 and 32,000, however large
the corpus; no vector of all pairs exists anywhere.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from panelworks.llm.common import strings, text_spans, with_fields, written
from panelworks.llm.tokens import encoder

#: Bytes of text that go together, and that are aligned at a time.
BATCH, SPAN = 4 << 20, 1 << 17
BUCKETS = 256
#: Chunks of texts that a worker remembers the ids of.
ROOM_FOR_CHUNKS = 250_000
#: Rows that are merged at a time.
FAN = 16
#: Places for each key of a level of the hash.
ROOM = 2
SPACE = "▁"


# tokens as bytes


class Other:
    """The second tokenizer: a model of the sentencepiece library, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.shown = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.width = np.array(list(map(len, self.shown)), np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def other(path: str) -> Other:
    """One for each Python worker and file."""
    return Other(path)


@functools.lru_cache(maxsize=2)
def shown_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    own = encoder(path, plain=True)
    byte_of = {letter: b for b, letter in own.letters.items()}
    out = [b""] * len(own.width)
    for token, i in own.tokenizer.get_vocab().items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


# alignment of some texts


class Vocabularies:
    """What each id of both tokenizers stands for: its number of bytes, and the type that holds an id."""

    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = encoder(path_a, plain=True), other(path_b)
        self.first.room = min(self.first.room, ROOM_FOR_CHUNKS)
        self.shown_a, self.shown_b = shown_bytes(path_a), self.second.shown
        self.width_a = np.array(list(map(len, self.shown_a)), np.int64)
        self.width_b = self.second.width
        self.kinds = [np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.shown_a, self.shown_b)]
        #: A byte-level vocabulary gives the bytes of a text again unless the text is normalised first.
        self.faithful = self.first.tokenizer.normalizer is None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of A, how many each text has, and the same of B; none of either where the bytes are not those of the text."""
        wanted = [" " + t if t else "" for t in texts]
        a, n_a = self.first.encode(wanted)
        a_of, b_of = self.shown_a.__getitem__, self.shown_b.__getitem__
        cuts = np.concatenate([[0], np.cumsum(n_a)]).tolist()
        kept_a, kept_b = [], []
        for k, (text, full) in enumerate(zip(texts, wanted, strict=True)):
            ids_a, ids_b = a[cuts[k] : cuts[k + 1]], self.second.encode(text) if text else []
            data = full.encode()
            same = b"".join(map(b_of, ids_b)) == data and (self.faithful or b"".join(map(a_of, ids_a.tolist())) == data)
            kept_a.append(ids_a.astype(self.kinds[0]) if same else np.zeros(0, self.kinds[0]))
            kept_b.append(np.array(ids_b if same else [], self.kinds[1]))
        flat = [np.concatenate([*x, np.zeros(0, kind)]) for x, kind in zip((kept_a, kept_b), self.kinds)]
        counts = [np.array(list(map(len, x)), "<u4") for x in (kept_a, kept_b)]
        return [flat[0], counts[0], flat[1], counts[1]]


@functools.lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One for each Python worker and pair of files."""
    return Vocabularies(path_a, path_b)


class Aligned:
    """Token ids and links of some texts, flat; a text without tokens has none of either.

    a, b: ids; n_a, n_b: how many each text has. pairs: A id * (ids of B) + B id of each link, n_links a text.
    """

    def __init__(self, both: Vocabularies, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.a, self.n_a, self.b, self.n_b = (x.astype(np.int64) for x in (a, n_a, b, n_b))
        width_a, width_b = both.width_a[self.a], both.width_b[self.b]
        self.end_a, self.end_b = np.cumsum(width_a), np.cumsum(width_b)  # both sides of a text have the same bytes
        low = np.searchsorted(self.end_b, self.end_a - width_a, side="right")
        high = np.searchsorted(self.end_b - width_b, self.end_a, side="left")
        links = high - low
        before = np.cumsum(links) - links
        second_of = np.arange(int(links.sum())) - np.repeat(before - low, links)
        self.pairs = np.repeat(self.a, links) * len(both.shown_b) + self.b[second_of]
        total = np.concatenate([[0], np.cumsum(links)])
        self.n_links = np.diff(total[np.concatenate([[0], np.cumsum(self.n_a)])])

    def per_text(self, of_link: np.ndarray) -> np.ndarray:
        """Sums over the links of each text."""
        total = np.concatenate([[0], np.cumsum(of_link)])
        return np.diff(total[np.concatenate([[0], np.cumsum(self.n_links)])])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs in ascending order, and how many of the texts hold each."""
        owner = np.repeat(np.arange(len(self.n_links), dtype=np.int64), self.n_links)
        distinct = np.unique((owner << np.int64(40)) | self.pairs)
        return np.unique(distinct & np.int64((1 << 40) - 1), return_counts=True)

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """The number of groups of each text, and the SHA-256 of their ids in decimal, '' for a text without tokens."""
        cut_a, cut_b = np.isin(self.end_a, self.end_b, assume_unique=True), np.isin(self.end_b, self.end_a, assume_unique=True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.concatenate([self.a, self.b])[order]
        last = np.concatenate([np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))])[order]
        digits = len(str(int(ids.max(initial=0))))
        letters = np.zeros((len(ids), digits + 1), np.uint8)
        for k in range(digits):
            letters[:, k] = ids // 10 ** (digits - 1 - k) % 10 + ord("0")
        letters[:, digits] = last
        size = np.ones(len(ids), np.int64)
        for k in range(1, digits):
            size += ids >= 10**k
        shown = np.arange(digits + 1) >= digits - size[:, None]
        data = letters[shown].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        total = np.concatenate([[0], np.cumsum(cut_a)])[np.concatenate([[0], np.cumsum(self.n_a)])]
        return np.diff(total), [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]


# minimal perfect hash


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another one for each level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n different keys: levels of bits, and the rank of a key's bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = ROOM * len(keys)
            place = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(sizes, np.concatenate([*levels, np.zeros(0, bool)]))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of one that was not there, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = at + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left, at = left[~hit], at + size
        return out

    def dumps(self) -> tuple[bytes, bytes]:
        return np.array(self.sizes, "<u4").tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def loads(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        found = np.frombuffer(sizes, "<u4").astype(int).tolist()
        return cls(found, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(found)).astype(bool))


# Spark


def _numbers(values: pa.ChunkedArray | pa.Array, kind: str = "<u4") -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in values.to_pylist()]


def _rows(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema)


def _tree(rows: DataFrame, n: int, merge: Callable[[pa.Table], dict], arrow: pa.Schema, ddl: str) -> DataFrame:
    """rows (bucket, share 0 to n - 1, ...) merged FAN shares at a time until each bucket has one row, share 0."""
    while True:
        n = -(-n // FAN)

        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            return _rows({"bucket": [key[0].as_py()], "share": [key[1].as_py()], **merge(group)}, arrow)

        rows = rows.withColumn("share", F.floor(F.col("share") / FAN).cast("long")).groupBy("bucket", "share").applyInArrow(run, ddl)
        if n <= 1:
            return rows


def _batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """batch, ids, a, n_a, b, n_b: a row for about SPAN bytes of texts, with their doc_ids and, compressed, their token ids and
    how many each has; rows of about BATCH bytes are a batch."""
    rows = docs.select("doc_id", "text").withColumn("_part", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType
    schema = StructType().add("batch", "long").add("ids", ArrayType(kind))
    for name in PACKED:
        schema = schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used, both = 0, 0, vocabularies(path_a, path_b)
        for batch in batches:
            for x, y in text_spans(batch["text"], SPAN):
                part = batch.slice(x, y - x)
                size = (pc.sum(pc.binary_length(part["text"])).as_py() or 0) + 64 * len(part)  # empty texts take room as well
                if used and used + size > BATCH:
                    number, used = number + 1, 0
                used += size
                packed = [pa.array([_packed(v)], pa.binary()) for v in both.encode(strings(part["text"]))]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["doc_id"])
                own = pa.array([(part["_part"][0].as_py() << 32) + number], pa.int64())
                yield pa.RecordBatch.from_arrays([own, ids, *packed], ["batch", "ids", *PACKED])
        both.first.forget()  # later stages run in the same workers and encode nothing

    return rows.mapInArrow(run, schema)


PACKED = ["a", "n_a", "b", "n_b"]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(row: dict, both: Vocabularies) -> Aligned:
    """The alignment of a row of _batches()."""
    kinds = dict(zip(PACKED, (both.kinds[0], "<u4", both.kinds[1], "<u4")))
    return Aligned(both, *[np.frombuffer(zstandard.decompress(row[c]), kinds[c]) for c in PACKED])


def _partial(dealt: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """batch, bucket, keys, n: the distinct pairs of a batch, or of its rows in one task, and how many of their documents hold each."""
    schema = "batch long, bucket int, keys binary, n binary"

    n_second = len(other(path_b).shown)

    def flush(batch: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))
        bucket = keys // n_second % BUCKETS
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        cut = lambda x: [y.tobytes() for y in np.split(x[order], first[1:])]
        columns = [pa.array([batch] * len(found), pa.int64()), pa.array(found, pa.int32())]
        columns += [pa.array(cut(x.astype("<u4")), pa.binary()) for x in (keys, n)]
        return pa.RecordBatch.from_arrays(columns, ["batch", "bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        current, parts = None, []
        for batch in batches:
            for k, own in enumerate(batch["batch"].to_pylist()):
                if own != current and parts:
                    yield flush(current, parts)
                    parts = []
                current = own
                keys, n = _unpacked({c: batch[c][k].as_py() for c in PACKED}, both).pair_counts()
                if len(keys):
                    parts.append((keys, n))
        if parts:
            yield flush(current, parts)

    return dealt.select("batch", *PACKED).mapInArrow(run, schema)


HASHED = "bucket int, share long, sizes binary, bits binary, keys binary"
_HASHED = pa.schema([("bucket", pa.int32()), ("share", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())])
_KEYS = pa.schema([("bucket", pa.int32()), ("share", pa.int64()), ("keys", pa.binary())])
_VECTOR = pa.schema([("bucket", pa.int32()), ("share", pa.int64()), ("counts", pa.binary())])


def _hashes(partial: DataFrame, n_shares: int) -> DataFrame:
    """The perfect hash of each bucket's distinct pairs, and the pairs in its order."""

    def merge(group: pa.Table) -> dict:
        return {"keys": [np.unique(np.concatenate(_numbers(group["keys"]))).tobytes()]}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<u4")
                hashed = PerfectHash.build(keys)
                order = np.zeros_like(keys)
                order[hashed.number(keys)] = keys
                sizes, bits = hashed.dumps()
                yield from _rows({"bucket": [row["bucket"]], "share": [0], "sizes": [sizes], "bits": [bits], "keys": [order.tobytes()]}, _HASHED).to_batches()

    merged = _tree(partial.select("bucket", "share", "keys"), n_shares * FAN, merge, _KEYS, "bucket int, share long, keys binary")
    return merged.mapInArrow(build, HASHED)


def _looked_up(hashed: PerfectHash, order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = hashed.number(keys)
    if (at < 0).any() or (order[at] != keys).any():
        raise ValueError("a pair is not in the hash of its bucket")
    return at


def _counts(partial: DataFrame, hashes: DataFrame, n_shares: int) -> DataFrame:
    """bucket, counts: the dense vector of each bucket, 64-bit."""

    def add(key: tuple[pa.Scalar, ...], own: pa.Table, table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        order = np.frombuffer(row["keys"], "<u4")
        hashed, vector = PerfectHash.loads(row["sizes"], row["bits"]), np.zeros(len(order), "<i8")
        for keys, n in zip(_numbers(own["keys"]), _numbers(own["n"]), strict=True):
            vector[_looked_up(hashed, order, keys)] += n  # the pairs of a row are distinct
        return _rows({"bucket": [key[0].as_py()], "share": [key[1].as_py()], "counts": [vector.tobytes()]}, _VECTOR)

    def merge(group: pa.Table) -> dict:
        return {"counts": [np.sum(_numbers(group["counts"], "<i8"), axis=0, dtype="<i8").tobytes()]}

    ddl = "bucket int, share long, counts binary"
    by_share = F.floor(F.col("share") / FAN).cast("long")
    left, right = partial.select("bucket", by_share.alias("share"), "keys", "n"), _everywhere(hashes, n_shares)
    vectors = left.groupBy("bucket", "share").cogroup(right.groupBy("bucket", "share")).applyInArrow(_where_both(add, _VECTOR), ddl)
    return _tree(vectors, n_shares, merge, _VECTOR, ddl).drop("share")


def _everywhere(rows: DataFrame, n_shares: int) -> DataFrame:
    """The row of each bucket for each share."""
    return rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shares - 1).cast("long"))))


def _where_both(run: Callable, schema: pa.Schema) -> Callable:
    """run for the keys that both sides have."""

    def both(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, left, right) if len(left) and len(right) else schema.empty_table()

    return both


_ANSWER = pa.schema([("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def _answers(partial: DataFrame, tables: DataFrame, n_shares: int, n_second: int) -> DataFrame:
    """batch, keys, counts, best: for the pairs of each row of partial how many documents hold them, and whether this is the
    highest count of their A id."""

    def answer(_: tuple[pa.Scalar, ...], own: pa.Table, table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        order, counts = np.frombuffer(row["keys"], "<u4"), np.frombuffer(row["counts"], "<i8")
        hashed = PerfectHash.loads(row["sizes"], row["bits"])
        _, a = np.unique(order // n_second, return_inverse=True)
        highest = np.zeros(a.max() + 1, np.int64)
        np.maximum.at(highest, a, counts)
        best = counts == highest[a]
        at = [_looked_up(hashed, order, keys) for keys in _numbers(own["keys"])]
        columns = {"batch": own["batch"].to_pylist(), "keys": own["keys"].to_pylist(), "counts": [counts[x].tobytes() for x in at], "best": [best[x].tobytes() for x in at]}
        return _rows(columns, _ANSWER)

    by_share = F.floor(F.col("share") / FAN).cast("long")
    left, right = partial.select("batch", "bucket", by_share.alias("share"), "keys"), _everywhere(tables, n_shares)
    grouped = left.groupBy("bucket", "share").cogroup(right.groupBy("bucket", "share"))
    return grouped.applyInArrow(_where_both(answer, _ANSWER), "batch long, keys binary, counts binary, best binary")


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    path_a: a byte-level BPE of the tokenizers library, which encodes a space and the text; path_b: a sentencepiece model, which
    puts the space there itself. Strings of special tokens are plain text. n_best: links whose pair is in as many documents
    as any pair of its A id; count_sum: the documents of its pair, summed over the links. groups_sha256: of
    'a1,a2|b1;a3|b2,b3', the decimal ids of each group. Null and empty texts, and those whose tokens do not give the text's
    bytes again, have no tokens: zeros and ''. A document is a row: repeated rows and those of one doc_id count each for
    itself; a null doc_id stays. Columns other than doc_id and text are not read. Empty tables give an empty table.
    """
    dealt = written(_batches(docs, path_a, path_b), "aligned-docs")
    n_second = len(other(path_b).shown)
    partial = _partial(dealt, path_a, path_b)
    numbered = written(partial.withColumn("_hash", F.xxhash64("batch")), "pair-counts")
    n_batches = numbered.agg(F.count_distinct("batch")).first()[0]
    n_shares = max(1, -(-n_batches // FAN))
    shares = numbered.withColumn("share", F.pmod("_hash", F.lit(n_shares * FAN)).cast("long")).drop("_hash")
    hashes = written(_hashes(shares, n_shares).drop("share"), "pair-hashes")
    tables = written(_counts(shares, hashes, n_shares).join(hashes, "bucket"), "pair-tables")
    answers = _answers(shares, tables, n_shares, n_second)
    kind = docs.schema["doc_id"]
    schema = with_fields(docs.select("doc_id").schema, RESULT)
    names = [kind.name, *[f.split()[0] for f in RESULT.split(", ")]]

    def finish(_: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        both = vocabularies(path_a, path_b)
        joined = lambda name, t: np.frombuffer(b"".join(answers[name].to_pylist()), t)
        keys, at = np.unique(joined("keys", "<u4"), return_index=True)
        counts, best = joined("counts", "<i8")[at], joined("best", bool)[at]
        out = []
        for batch in own.to_batches():
            for k in range(len(batch)):
                aligned = _unpacked({c: batch[c][k].as_py() for c in PACKED}, both)
                place = np.searchsorted(keys, aligned.pairs)
                n_groups, digests = aligned.groups()
                sums = [aligned.per_text(best[place].astype(np.int64)), aligned.per_text(counts[place])]
                numbers = [pa.array(x, pa.int64()) for x in (aligned.n_a, aligned.n_b, n_groups, aligned.n_links, *sums)]
                out.append(pa.RecordBatch.from_arrays([batch["ids"][k].values, *numbers, pa.array(digests, pa.string())], names))
        return pa.Table.from_batches(out)

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema)
