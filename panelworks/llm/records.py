"""Length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes, payload, masked CRC-32 of the
payload. The mask rotates the CRC right by 15 bits and adds a constant, so that a checksum over data that holds
checksums stays useful. A payload is the width of an id (2 or 4) and whether there is a doc_id (a byte each), the doc_id and
the number of ids in the part before this record (8 bytes each), then the ids; all little-endian.

The index is a Parquet table with a row for each record: any row can be read alone, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import scratch, strings, text_spans
from panelworks.llm.tokens import encoder

#: Fixed value of the mask of length-delimited records.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
FIXED = struct.Struct("<BBqq")
TAIL = struct.Struct("<I")

INDEX = "part int, seq long, doc_id long, file string, offset long, size long, n_tokens long, part_start long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked_crc(length)), payload, TAIL.pack(masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; ValueError if a checksum or the length is wrong."""
    n, crc = HEAD.unpack_from(data)
    if masked_crc(data[:8]) != crc or len(data) != n + HEAD.size + TAIL.size:
        raise ValueError("the record's length is damaged")
    payload = data[HEAD.size : HEAD.size + n]
    if masked_crc(payload) != TAIL.unpack_from(data, HEAD.size + n)[0]:
        raise ValueError("the record's payload is damaged")
    return payload


def payload_of(doc_id: int | None, before: int, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return FIXED.pack(width, doc_id is not None, doc_id or 0, before) + ids.astype(f"<u{width}").tobytes()


def record_of(payload: bytes) -> tuple[int | None, int, np.ndarray]:
    """(doc_id, ids of the part before it, ids) of a payload."""
    width, known, doc_id, before = FIXED.unpack_from(payload)
    return doc_id if known else None, before, np.frombuffer(payload, f"<u{width}", offset=FIXED.size)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes every text's ids and end_id in ascending doc_id order, and returns the index, itself written under `path`.

    Null and empty texts give a record of end_id alone. Rows of equal doc_id stay, each with a record, in their order in
    the table. An empty table gives an empty index. Other columns of docs are not read. Files are named by the attempt
    that wrote them and the index names only those of finished attempts, so that a lost executor or a second attempt
    leaves at most files that nothing points to.
    """
    path = path or scratch(docs.sparkSession, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/data", recursive=True)
        task, out, name, at, k, seq, start = TaskContext.get(), None, "", 0, 0, 0, 0
        enc = encoder(tokenizer)
        try:
            for batch in batches:
                for a, b in text_spans(batch["text"]):
                    doc_ids = batch["doc_id"].slice(a, b - a)
                    ids, counts = enc.encode(strings(batch["text"].slice(a, b - a)))
                    rows, done = [], 0
                    for doc_id, n in zip(doc_ids.to_pylist(), counts.tolist(), strict=True):
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at, k = f"data/part-{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}.rec", 0, k + 1
                            out = store.open_output_stream(f"{folder}/{name}")
                        data = frame(payload_of(doc_id, start, np.append(ids[done : done + n], np.array(end_id, ids.dtype))))
                        out.write(data)
                        rows.append((task.partitionId(), seq, name, at, len(data), n + 1, start))
                        at, seq, start, done = at + len(data), seq + 1, start + n + 1, done + n
                    part, seqs, names, offsets, sizes, tokens, starts = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()), pa.array(seqs, pa.int64()), doc_ids.cast(pa.int64()), pa.array(names), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(starts, pa.int64())],
                        ["part", "seq", "doc_id", "file", "offset", "size", "n_tokens", "part_start"],
                    )
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    ordered.select("doc_id", "text").mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))  # a row for each part
    return index.join(before, "part").withColumn("path", F.lit(path))


def read_records(index: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The records that the index rows point to, checked: doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers).

    All but the number of ids in the parts before comes from the files; a record that is not the one of its index row
    raises an error. Any subset of the index in any order will do; blocks of `block_bytes` of a file are dealt to the tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened, source, store, root = None, None, None, None
        try:
            for batch in batches:
                rows = []
                for path, file, offset, size, doc_id, part_start, part_before in zip(*(batch[c].to_pylist() for c in USED), strict=True):
                    if opened != (path, file):
                        if source is not None:
                            source.close()
                        if store is None or root[0] != path:
                            store, folder = fs.FileSystem.from_uri(path)
                            root = (path, folder)
                        source, opened = store.open_input_file(f"{root[1]}/{file}"), (path, file)
                    own_id, before, ids = record_of(unframe(source.read_at(size, offset)))
                    if (own_id, before) != (doc_id, part_start):
                        raise ValueError(f"{file} at {offset} holds another record than its index row tells")
                    rows.append((own_id, part_before + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        finally:
            if source is not None:
                source.close()

    block = F.floor(F.col("offset") / block_bytes)
    dealt = index.repartition("file", block).sortWithinPartitions("file", "offset")
    return dealt.select(*USED).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


USED = ["path", "file", "offset", "size", "doc_id", "part_start", "part_before"]
