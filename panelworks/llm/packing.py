"""Packing of token sequences: best fit, then swap-based local search.

Pieces of exactly the capacity are sequences already. The others are dealt at random to groups of about `group_items`;
each group is packed by decreasing best fit, and then bins are emptied: the least filled bin gives mass to fuller ones by
moving a document, by exchanging one of its documents for a smaller one, or two of its documents for one smaller than
both. Each step raises the sum of squared fills, so the search ends; it ends early when no packing can have fewer bins.
A group loses less than a bin on average, whatever the number of groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import strings, text_spans, with_fields, written
from panelworks.llm.tokens import encoder

CAPACITY = 1024
GROUP_ITEMS = 4096


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers by decreasing best fit; ties go to the item that comes first and the bin opened last."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        room -= size
        stacks[room].append(b)
        rooms |= 1 << room
    return bins


def swap_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search on bins, see the module's docstring. Deterministic."""
    fewest = -(-int(sizes.sum()) // capacity)
    fill = np.array([sizes[b].sum() for b in bins], np.int64)
    live = [i for i in range(len(bins)) if bins[i]]
    stuck: set[tuple] = set()  # sizes in a donor for which nothing helped, until a bin changes
    while len(live) > fewest:
        emptied = False
        for donor in sorted((i for i in live if fill[i] < capacity), key=lambda i: (fill[i], i)):
            if len(live) <= fewest:
                break
            while bins[donor]:
                own = bins[donor]
                held = tuple(sorted(sizes[own].tolist()))
                if held in stuck:
                    break
                amounts: dict[int, tuple[int, ...]] = {}
                for i, x in enumerate(own):
                    amounts.setdefault(int(sizes[x]), (x,))
                distinct: dict[int, list[int]] = {}  # two of a size are enough for the pairs
                for x in own:
                    same = distinct.setdefault(int(sizes[x]), [])
                    if len(same) < 2:
                        same.append(x)
                few = [x for same in distinct.values() for x in same]
                for i, x in enumerate(few):
                    for y in few[i + 1 :]:
                        amounts.setdefault(int(sizes[x] + sizes[y]), (x, y))
                give = np.array(sorted(amounts), np.int64)
                # what may come back: nothing from a bin, or one of its items
                others = [b for b in live if b != donor and bins[b] and fill[b] < capacity and fill[b] >= fill[donor]]
                if not others:
                    stuck.add(held)
                    break
                at = np.array([b for b in others for _ in range(len(bins[b]) + 1)], np.int64)
                back = np.array([x for b in others for x in (-1, *bins[b])], np.int64)
                size = np.where(back < 0, 0, sizes[back])
                best = np.searchsorted(give, capacity - fill[at] + size, side="right") - 1
                moved = np.where(best >= 0, give[best], 0) - size
                gain = np.where(moved > 0, moved * (fill[at] - fill[donor] + moved), 0)
                k = int(np.argmax(gain))
                if gain[k] <= 0:
                    stuck.add(held)
                    break
                stuck.clear()
                out = amounts[int(give[best[k]])]
                target = int(at[k])
                bins[donor] = [x for x in own if x not in out]
                bins[target] = [x for x in bins[target] if x != back[k]] + list(out)
                if back[k] >= 0:
                    bins[donor].append(int(back[k]))
                fill[donor] -= moved[k]
                fill[target] += moved[k]
            if not bins[donor]:
                live.remove(donor)
                emptied = True
        if not emptied:
            break
    return [bins[i] for i in live]


def pack_items(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; sizes from 1 to capacity."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, items in enumerate(swap_search(sizes, best_fit(sizes, capacity), capacity)):
        at = np.array(sorted(items), np.int64)
        bin_of[at] = k
        offset[at] = np.cumsum(sizes[at]) - sizes[at]
    return bin_of, offset


PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row for each piece of each text's ids and end_id; longer ones are cut from the end, so that only the first piece may be shorter.

    Null and empty texts are end_id alone. Every row of docs counts, equal doc_ids too; uid tells rows apart.
    `ids` adds the ids themselves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for a, b in text_spans(batch["text"]):
                flat, counts = enc.encode(strings(batch["text"].slice(a, b - a)))
                rows, at = [], 0
                for uid, doc_id, n in zip(batch["uid"].slice(a, b - a).to_pylist(), batch["doc_id"].slice(a, b - a).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(flat[at : at + n].astype("<u4"), np.uint32(end_id))
                    at += n
                    starts = [0, *range((n + 1) % capacity or capacity, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n + 1], strict=True)):
                        rows.append((uid, doc_id, k, s, e - s, zlib.crc32(own[s:e].tobytes()), *([own[s:e].tolist()] if ids else [])))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    rows = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """pieces with sequence_id and offset: every piece in one sequence of at most `capacity`, without gaps.

    pieces needs uid, piece and length (1 to capacity) and should be a written table, so that uid stays as it is when a
    task runs again. Other columns stay, columns named sequence_id or offset are replaced. Groups hold about
    `group_items` pieces by a hash of uid and piece: equal texts, equal lengths and a hot source spread evenly.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = [f"c{k}" for k in range(len(pieces.columns))]
    uid, piece, length = (names[pieces.columns.index(c)] for c in ("uid", "piece", "length"))
    plain = pieces.toDF(*names)
    short = plain.filter(F.col(length) < capacity)
    groups = max(1, -(-short.count() // group_items))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([uid, piece], kind="stable", ignore_index=True)
        bin_of, frame["offset"] = pack_items(frame[length].to_numpy(np.int64), capacity)
        frame["sequence_id"] = -1 - (frame["group"] * (2 * group_items + 64) * 1024 + bin_of)
        return frame.drop(columns="group")

    dealt = short.withColumn("group", F.pmod(F.xxhash64(uid, piece), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(one, with_fields(plain.schema, "offset long, sequence_id long"))
    # a full piece is its own sequence; uid is used, as packed sequences have negative numbers
    full = plain.filter(F.col(length) == capacity).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", F.monotonically_increasing_id())
    return packed.unionByName(full.select(*packed.columns)).toDF(*pieces.columns, "offset", "sequence_id")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text of docs."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity).drop("uid")


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the doc_ids, pieces and lengths in them, for training files."""
    packed = pack(written(token_pieces(docs, tokenizer, end_id, capacity, ids=True), "pieces"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.length").alias("lengths")
    )
