"""Exact deduplication by compressed radix tries.

Each task first puts its own rows into a trie, so that a text with very many copies leaves a task as one row a window.
These rows go to partitions of (length, content hash), where full byte strings are inserted into a trie whose terminal
nodes hold the smallest doc_id. A trie over its budget detaches whole subtrees: what they hold and what comes below them
later goes to the task's own temporary file, and each is finished after the rest. Such a file is lost with its executor,
and the task that runs again writes its own. A text that very many windows hold is merged in many tasks first. Copies get
their owner by a join on the row that stood for them.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import SALTS, hot_keys, skew_join, strings, text_spans, written

#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1
WINDOW_BYTES = 32 << 20
TRIE_BYTES = 96 << 20


def normalised(text: str) -> bytes:
    """UTF-8 of text with each run of ASCII white space as one space."""
    data = text.encode()
    out = b" ".join(data.split())
    if data[:1].isspace():
        out = b" " + out
    if data[-1:].isspace() and out != b" ":
        out += b" "
    return out


class Node:
    """The edge key[lo:hi] that leads to it, children by first byte; `rows` are those whose key ends here. `file`: spilled from here on."""

    __slots__ = ("key", "lo", "hi", "kids", "rows", "file")

    def __init__(self, key: bytes, lo: int, hi: int):
        self.key, self.lo, self.hi = key, lo, hi
        self.kids: dict[int, Node] = {}
        self.rows = self.file = None


def _common(a: bytes, at: int, b: bytes, to: int, most: int) -> int:
    """Length of the common prefix of a[at:] and b[to:], `most` at most, by halving."""
    if a[at : at + most] == b[to : to + most]:
        return most
    lo, hi = 0, most - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[at + lo : at + mid] == b[to + lo : to + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Patricia trie: insert() returns the node where a key ends, or the spilled node that it lies below."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def insert(self, key: bytes) -> Node:
        node, at, n = self.root, 0, len(key)
        while at < n:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key, at, n)
                return kid
            span = kid.hi - kid.lo
            same = _common(kid.key, kid.lo, key, at, min(span, n - at))
            if same < span:
                middle = node.kids[key[at]] = Node(kid.key, kid.lo, kid.lo + same)
                kid.lo += same
                middle.kids[kid.key[kid.lo]] = kid
                kid = middle
            node, at = kid, at + same
            if node.file is not None:
                return node
        return node


#: Bytes that a key's nodes and a row take beside the key.
NODE_BYTES, ROW_BYTES = 400, 120


class SpillingTrie:
    """Rows (row, least, count, key) in a trie; over `budget` bytes the largest subtree below the first branch goes to a file."""

    FRAME = struct.Struct("<qqqq")

    def __init__(self, budget: int = TRIE_BYTES):
        self.budget, self.trie, self.total = budget, Trie(), 0
        self.spilled: list[Node] = []

    def add(self, row: int, least: int, count: int, key: bytes) -> None:
        node = self.trie.insert(key)
        if node.file is not None:
            self._write(node, row, least, count, key)
            return
        if node.rows is None:
            node.rows, node.key = [], key
            self.total += len(key) + NODE_BYTES
        node.rows.append((row, least, count))
        self.total += ROW_BYTES
        if self.total > self.budget:
            self._spill()

    def _write(self, node: Node, row: int, least: int, count: int, key: bytes) -> None:
        node.file.write(self.FRAME.pack(row, least, count, len(key)) + key)

    def _ends(self, top: Node) -> Iterator[Node]:
        todo = [top]
        while todo:
            node = todo.pop()
            if node.rows:
                yield node
            todo += node.kids.values()

    def _held(self, top: Node) -> int:
        return sum(len(x.key) + NODE_BYTES + ROW_BYTES * len(x.rows) for x in self._ends(top))

    def _spill(self) -> None:
        """Detaches the largest subtree below the first branch; a single key and its rows stay, whatever the budget."""
        top = self.trie.root
        while len(kids := [x for x in top.kids.values() if x.file is None]) == 1 and not top.rows:
            top = kids[0]
        if not kids:
            return
        sizes = [self._held(x) for x in kids]
        size, kid = max(zip(sizes, kids, strict=True), key=lambda x: x[0])
        stub = Node(kid.key, kid.lo, kid.lo + 1)  # the first byte of the edge, so that whatever goes this way meets the file
        stub.file = tempfile.TemporaryFile()
        top.kids[kid.key[kid.lo]] = stub
        self.spilled.append(stub)
        for node in self._ends(kid):
            for row, least, count in node.rows:
                self._write(stub, row, least, count, node.key)
        self.total -= size

    def classes(self) -> Iterator[tuple[int, int, int, int]]:
        """(row, least, owner, count) for each row that was added; the smallest (least, row) owns a class."""
        for node in self._ends(self.trie.root):
            least, owner = min((x[1], x[0]) for x in node.rows)
            count = sum(x[2] for x in node.rows)
            for row, _, _ in node.rows:
                yield row, least, owner, count
        self.trie = Trie()
        for stub in self.spilled:
            stub.file.seek(0)
            below = SpillingTrie(self.budget)
            while head := stub.file.read(self.FRAME.size):
                row, least, count, n = self.FRAME.unpack(head)
                below.add(row, least, count, stub.file.read(n))
            stub.file.close()
            yield from below.classes()


LOCAL = "row long, length long, hash long, text_sha256 string, text binary, least long, members array<long>"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a window of this task's rows, with the ids of all its rows."""
    base, made = TaskContext.get().partitionId() << 36, 0
    trie, nodes, size = Trie(), [], 0

    def flush() -> pa.RecordBatch:
        nonlocal trie, nodes, size, made
        rows = [base + made + k for k in range(len(nodes))]
        made += len(nodes)
        texts = [key for _, key in nodes]
        shas = [hashlib.sha256(x).digest() for x in texts]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([int.from_bytes(x[:8], "little", signed=True) for x in shas], pa.int64()),
                pa.array([x.hex() for x in shas]),
                pa.array(texts, pa.binary()),
                pa.array([min(LAST if i is None else i for i in node.rows) for node, _ in nodes], pa.int64()),
                pa.array([node.rows for node, _ in nodes], pa.list_(pa.int64())),
            ],
            ["row", "length", "hash", "text_sha256", "text", "least", "members"],
        )
        trie, nodes, size = Trie(), [], 0
        return out

    for batch in batches:
        for a, b in text_spans(batch["text"]):
            for doc_id, text in zip(batch["doc_id"].slice(a, b - a).to_pylist(), strings(batch["text"].slice(a, b - a)), strict=True):
                key = normalised(text)
                node = trie.insert(key)
                if node.rows is None:
                    node.rows = []
                    nodes.append((node, key))
                    size += len(key)
                node.rows.append(doc_id)
                size += 16
            if size > WINDOW_BYTES:
                yield flush()
    if nodes:
        yield flush()


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = SpillingTrie()
    for batch in batches:
        for row, least, count, text in zip(*(batch[c].to_pylist() for c in ("row", "least", "count", "text")), strict=True):
            trie.add(row, least, count, text)
    out: list[tuple] = []
    for x in trie.classes():
        out.append(x)
        if len(out) == 50_000:
            yield _class_batch(out)
            out = []
    if out:
        yield _class_batch(out)


def _class_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["row", "keep_id", "keep_row", "group_size"])


def _classes(texts: DataFrame, *deal: str) -> DataFrame:
    """(row, keep_id, keep_row, group_size) of rows (row, length, hash, least, count, text)."""
    return texts.repartition("length", "hash", *deal).select("row", "least", "count", "text").mapInArrow(_owners, "row long, keep_id long, keep_row long, group_size long")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal if they are after each run of ASCII white space has become one space; null is the empty text. The
    row with the smallest doc_id stays; of several rows with that doc_id and text, the first read; a null doc_id comes
    last. Nothing but doc_id and text is read, an empty table gives an empty one.
    """
    local = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_local, LOCAL), "texts")
    texts = local.select("row", "length", "hash", "least", F.size("members").cast("long").alias("count"), "text")
    # texts of very many windows: each of SALTS tasks brings its share down to one row first
    hot = hot_keys(texts, "hash")
    if hot:
        is_hot = F.col("hash").isin(hot)
        shares = written(_classes(texts.filter(is_hot).withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))), "_salt"), "shares")
        firsts = shares.filter("row = keep_row").select("row", F.col("group_size").alias("share"))
        merged = texts.filter(is_hot).join(firsts, "row").select("row", "length", "hash", "least", F.col("share").alias("count"), "text")
        owners = written(_classes(texts.filter(~is_hot).unionByName(merged)), "owners")
        of_share = owners.select(F.col("row").alias("keep_row"), "keep_id", F.col("keep_row").alias("_keep"), "group_size")
        later = skew_join(shares.select("row", "keep_row"), of_share, "keep_row").select("row", "keep_id", F.col("_keep").alias("keep_row"), "group_size")
        classes = owners.join(shares.select("row"), "row", "left_anti").unionByName(later)
    else:
        classes = _classes(texts)
    members = local.select("row", "text_sha256", "least", F.posexplode("members").alias("_k", "doc_id"), F.array_position("members", F.col("least")).alias("_first"))
    kept = (F.col("row") == F.col("keep_row")) & F.when(F.col("_first") > 0, F.col("_k") + 1 == F.col("_first")).otherwise(F.col("_k") == 0)
    joined = members.join(classes, "row").withColumn("kept", kept)
    keep_id = F.when(F.col("keep_id") != LAST, F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), "group_size", "kept", "text_sha256")
