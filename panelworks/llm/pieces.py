"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are put one after another and indexed by a suffix array. Every piece of the model is
found in it by binary search; its range of suffixes is its occurrences, each an edge from where it begins to where it
ends. The edges, by position, are what symbols can be merged to. Relaxation joins the two neighbouring symbols under the
best edge of a word, until no edge spans two symbols: the segmentation of a BPE model. Short words are relaxed all at once,
each long one, such as a text without spaces, by a heap of its edges. Characters that no piece covers become byte pieces.
Words are remembered, so that each is encoded about once a task.

The table of edges takes 4 bytes for each letter and length of a piece, about 70 bytes a letter: texts of 2 MB at a time,
or one longer text alone.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelworks.llm.common import strings, text_spans

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Longer words are relaxed one by one; together with the others each of their merges would be a round for all.
LONG_WORD = 48


#: The code point between words in the text that is indexed; it is in no word, as words end at spaces.
GAP = ord(" ")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: varints and fixed ones as numbers, others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def check_model(path: str) -> None:
    """ValueError unless the model file is what Pieces can encode: a BPE, texts not normalised, no user-defined pieces, with
    bytes for other letters. Field numbers are those of the library's model files."""
    with open(path, "rb") as file:
        fields = list(_fields(file.read()))
    trainer, normaliser = (dict(_fields(next((v for k, v in fields if k == n), b""))) for n in (2, 3))
    kinds = {dict(_fields(v)).get(3, 1) for k, v in fields if k == 1}
    wrong = [
        trainer.get(3, 1) != 2 and "is no BPE model",
        not trainer.get(35, 0) and "has no byte pieces",
        bool(normaliser.get(2)) and "normalises texts",
        not normaliser.get(3, 1) and "puts no space before a text",
        bool(normaliser.get(4, 1)) and "drops spaces",
        4 in kinds and "has user-defined pieces",
    ]
    if any(wrong):
        raise ValueError(f"{path} " + ", ".join(x for x in wrong if x))


class Pieces:
    """Encoder and decoder of one BPE model of the sentencepiece library. `room` bounds the words remembered."""

    def __init__(self, path: str, room: int = 500_000):
        import sentencepiece

        check_model(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in usual):
            raise ValueError("a piece of the model goes over a word's end")
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        scores = np.array([model.get_score(i) for i in usual])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = np.full(n + 1, 1 << 30, np.int64)  # the last stands for no piece
        self.rank[usual] = order
        self.none = n
        self.size = np.array([len(names[i]) for i in usual], np.int64)
        self.longest = int(self.size.max())
        self.codes = np.zeros((len(usual), self.longest), np.int64)  # the letters of each piece, 0 after its end
        self.codes[np.arange(self.longest) < self.size[:, None]] = [ord(c) for i in usual for c in names[i]]
        self.usual = np.array(usual, np.int64)
        self.letters = np.unique(self.codes[self.codes > 0])
        shown = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].encode() for i in range(n)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_n = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_n) - self.shown_n
        self.room = room
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    # suffix array and edges

    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int, int]:
        """Suffix array of letter numbers by as many letters as the longest piece has; the keys in its order, a letter's bits, letters a key."""
        bits = 8 if text.max(initial=0) < 255 else 16
        per_key = 64 // bits
        n_keys = -(-self.longest // per_key)
        padded = np.concatenate([text, np.zeros(n_keys * per_key, np.int64)]).astype(np.uint64)
        keys = []
        for k in range(n_keys):
            key = np.zeros(len(text), np.uint64)
            for j in range(per_key):
                key = (key << np.uint64(bits)) | padded[k * per_key + j : k * per_key + j + len(text)]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return order, [key[order] for key in keys], bits, per_key

    def _edges(self, text: np.ndarray) -> np.ndarray:
        """Table [place, letters]: the piece that begins there and has so many letters, or none. text: code points, GAP between words."""
        present = np.intersect1d(np.unique(text), self.letters)
        number = np.zeros(int(max(text.max(initial=0), self.letters[-1])) + 1, np.int64)
        number[present] = np.arange(2, len(present) + 2)
        own = np.where(text == GAP, 0, np.maximum(number[text], 1))  # 1: a letter of no piece
        order, keys, bits, per_key = self._suffixes(own)
        firsts, places, sizes = [], [], []
        numbered = number[self.codes]
        some = np.flatnonzero((numbered > 0).sum(axis=1) == self.size)  # pieces of which all letters are there
        wanted, size, numbered = self.usual[some], self.size[some], numbered[some].astype(np.uint64)
        low = np.zeros((len(keys), len(some)), np.uint64)
        for at in range(len(keys) * per_key):
            low[at // per_key] = (low[at // per_key] << np.uint64(bits)) | (numbered[:, at] if at < self.longest else np.uint64(0))
        for k in range(len(keys)):  # pieces that end within key k
            here = np.flatnonzero((size > k * per_key) & (size <= (k + 1) * per_key))
            free = np.uint64(bits) * ((k + 1) * per_key - size[here]).astype(np.uint64)
            high = low[k][here] | ((np.uint64(1) << free) - np.uint64(1))
            if k == 0:
                lo, hi = np.searchsorted(keys[0], low[0][here]), np.searchsorted(keys[0], high, side="right")
            else:  # within the suffixes that share the keys before
                lo, hi = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
                from_, to = np.searchsorted(keys[0], low[0][here]), np.searchsorted(keys[0], low[0][here], side="right")
                for x in np.flatnonzero(to > from_).tolist():
                    a, b = int(from_[x]), int(to[x])
                    for j in range(1, k):
                        a, b = a + int(np.searchsorted(keys[j][a:b], low[j][here[x]])), a + int(np.searchsorted(keys[j][a:b], low[j][here[x]], side="right"))
                    lo[x] = a + int(np.searchsorted(keys[k][a:b], low[k][here[x]]))
                    hi[x] = a + int(np.searchsorted(keys[k][a:b], high[x], side="right"))
            often = hi - lo
            ends = np.cumsum(often)
            at = np.repeat(lo - (ends - often), often) + np.arange(int(often.sum()))
            places.append(order[at])
            firsts.append(np.repeat(wanted[here], often))
            sizes.append(np.repeat(size[here], often))
        table = np.full((len(text) + 1, self.longest + 1), self.none, np.int32)
        table[np.concatenate(places), np.concatenate(sizes)] = np.concatenate(firsts)
        return table

    # relaxation

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final symbols of all words, by word: word, code point of the first letter, piece."""
        text = np.frombuffer((" ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)  # words hold no space
        table = self._edges(text)
        starts = np.concatenate([[0], np.flatnonzero(text == GAP) + 1])
        long = np.flatnonzero(np.diff(starts) - 1 > LONG_WORD)
        done = [(np.full(len(a), k), a, b) for k in long.tolist() for a, b in [self._by_heap(table, int(starts[k]), int(starts[k + 1]) - 1)]]
        word = np.cumsum(text == GAP)
        begin = np.flatnonzero((text != GAP) & ~np.isin(word, long))
        word = word[begin]
        end = begin + 1
        while len(begin):
            size = end[1:] - begin[:-1]
            joins = (word[1:] == word[:-1]) & (size <= self.longest)
            rank = np.where(joins, self.rank[table[begin[:-1], np.where(joins, size, 0)]], 1 << 30)
            best = np.append(rank, 1 << 30)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(best, heads)
            alive = least < 1 << 30
            per_word = np.diff(heads, append=len(begin))
            live = np.repeat(alive, per_word)
            done.append((word[~live], begin[~live], end[~live]))
            hit = np.flatnonzero(live & (best == np.repeat(least, per_word)))
            first = hit[np.flatnonzero(np.diff(word[hit], prepend=-1))] if len(hit) else hit  # the leftmost of each word
            end[first] = end[first + 1]
            live[first + 1] = False
            begin, end, word = begin[live], end[live], word[live]
        word, begin, end = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(begin, kind="stable")
        word, begin, size = word[order], begin[order], (end - begin)[order]
        return word, text[begin], table[begin, size]

    def _by_heap(self, table: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the final symbols of the word at lo to hi."""
        n = hi - lo
        ranks = self.rank[table[lo:hi]]
        size, before, dead = [1] * n, list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = a + size[a]
            if b < n and (both := size[a] + size[b]) <= self.longest and (rank := int(ranks[a, both])) < 1 << 30:
                heapq.heappush(heap, (rank, a, both))

        for a in np.flatnonzero(ranks[:, 2] < 1 << 30).tolist():
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            if dead[a] or a + size[a] >= n or size[a] + size[a + size[a]] != both:
                continue
            dead[a + size[a]] = True
            size[a] = both
            if a + both < n:
                before[a + both] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        begin = np.flatnonzero(~np.array(dead))
        return lo + begin, lo + begin + np.array(size)[begin]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of words not seen before, in the order of their rows."""
        owner, letter, flat = self._relax(fresh)
        flat = flat.astype(np.int64)
        if (other := np.flatnonzero(flat == self.none)).size:  # letters of no piece, as bytes
            bytes_of = [[self.byte_id[x] for x in chr(c).encode()] for c in letter[other].tolist()]
            width = np.ones(len(flat), np.int64)
            width[other] = [len(x) for x in bytes_of]
            spread = np.repeat(np.arange(len(flat)), width)
            owner, flat, before = owner[spread], flat[spread], flat
            flat[before[spread] == self.none] = np.array([i for x in bytes_of for i in x], np.int64)
        length = np.bincount(owner, minlength=len(fresh))
        start = np.cumsum(length) - length
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + start])
        self.length = np.concatenate([self.length, length])
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each text has. A space goes before each text that is not empty, as in the library."""
        if len(self.rows) > self.room:
            self._clear()
        known, fresh, rows, counts = self.rows, [], [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            words = text.replace(" ", SPACE).split(SPACE)
            if "" in words:  # several spaces together stay with the word after them
                words = [x[1:] for x in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
            counts.append(len(words))
            for x in words:
                row = known.get(x)
                if row is None:
                    row = known[x] = len(known)
                    fresh.append(SPACE + x)
                rows.append(row)
        if fresh:
            self._learn(fresh)
        at = np.array(rows, np.int64)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(counts)], prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of flat ids: pieces one after another, byte pieces as bytes, a space for each mark, the first one dropped."""
        lengths = self.shown_n[ids]
        ends = np.cumsum(lengths)
        data = self.shown[np.repeat(self.shown_at[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(cuts, cuts[1:])]
        return [x[1:] if x[:1] == " " else x for x in texts]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each Python worker and file."""
    return Pieces(path)


ENCODED = "n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_texts(docs: DataFrame, model: str, ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (ids as little-endian unsigned 32-bit integers), decoded_crc32 (decoded text, UTF-8) and round_trip for each row of docs.

    round_trip: decoding gives the text again, the model's space mark in it counting as a space. `ids` adds the ids.
    Null and empty texts have no ids. Rows of one doc_id stay apart; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for a, b in text_spans(batch["text"]):
                texts = strings(batch["text"].slice(a, b - a))
                flat, counts = own.encode(texts)
                back = own.decode(flat, counts)
                cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
                lists = [flat[x:y] for x, y in zip(cuts, cuts[1:])]
                columns = [
                    batch["doc_id"].slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    pa.array([x == y.replace(SPACE, " ") for x, y in zip(back, texts, strict=True)]),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"]
                if ids:
                    columns.append(pa.array([x.tolist() for x in lists], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {ENCODED}" + (", ids array<int>" if ids else ""))
