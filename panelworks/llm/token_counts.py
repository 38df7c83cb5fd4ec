"""Token counts of whole texts by a tokenizer with word ends; huge texts in overlapping chunks that are spliced.

A huge text is cut into windows that overlap around each cut. Windows are encoded apart, with offsets, wherever Spark puts
them. Two neighbours are spliced at a place in their overlap where both end a word: the splitting into words reads from left
to right and forgets what was before a word's end, so from there on the right window's words are those of the whole text,
whatever its beginning looked like; up to there the left window's are, as what cuts it off lies at least MARGIN letters
further on. A place does not count if the letter after it can unite with the one before it under normalisation, or if no
word but an added token ends there. Where an overlap has no such place (a word longer than it), the text is cut anew, into
windows and overlaps WIDER times as large, until one window is the whole text.

The count of a text is that of its last window and, for each splice, the tokens before it in the left window less those in
the right one: sums, so no task sees all of a text's windows.

Texts that are not huge are counted whole. No word goes over a space or line end, so what stands between two of them is
encoded once and its count is remembered; ROOM bounds what is remembered. Of letters and marks after them, each is a word.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import strings, text_spans, with_fields, written
from panelworks.llm.tokens import byte_letters

#: Letters of a window besides its overlaps; longer texts are huge. Letters that a window reaches over each of its cuts.
CHUNK, OVERLAP = 1 << 14, 1 << 8
#: What windows and overlaps are multiplied by where a splice is not found.
WIDER = 8
LIMIT = 2048
ROOM = 500_000
#: Letters that normalisation leaves alone but for their case, one to one, then marks that begin no contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


@functools.cache
def _uniting() -> frozenset[str]:
    """Letters that normalisation may reorder, or unite with a letter before them."""
    jamo = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # vowels and finals of Hangul
    letters = [chr(c) for c in range(sys.maxunicode + 1)]
    seconds = {chr(int(d.split()[1], 16)) for d in map(unicodedata.decomposition, letters) if d and d[0] != "<" and " " in d}
    return frozenset(jamo | seconds | {c for c in letters if unicodedata.combining(c)})


class Counter:
    """Counts and word ends by one tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError(f"{path} marks no word ends")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or " " in t.content for t in added.values()):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        self.margin = 4 + max((len(t.content) for t in added.values()), default=0)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix) and i not in added]] = True

        self.known: dict[str, int] = {}
        self.words = Tokenizer.from_file(path)  # for words in lower case, in the letters by which the vocabulary writes bytes
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words.encode_special_tokens = True

    def _parts(self, texts: list[str]) -> list[list[str]]:
        """What stands between the spaces and line ends of each text; the counts of all of it are known afterwards."""
        if len(self.known) > ROOM:
            self.known = {}
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        words, others, marked = set(), set(), []
        for part in set(chain.from_iterable(parts)).difference(self.known):
            if plain := _PLAIN.fullmatch(part):
                word, marks = plain.groups()
                words.add(word)
                if marks:
                    others.add(marks)
                    marked.append((part, word, marks))
            else:
                others.add(part)
        known = self.known
        self._learn_words(list(words.difference(known)))
        rest = list(others.difference(known))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            known.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        known.update((part, known[word] + known[marks]) for part, word, marks in marked)
        return parts

    def _learn_words(self, words: list[str]) -> None:
        """Counts of words of _PLAIN letters, 512 in one text; each has one token that ends a word, its last."""
        letters = byte_letters()
        low = [w.lower() for w in words]
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in low]
        lines = [" ".join(shown[at : at + 512]) for at in range(0, len(shown), 512)]
        for at in range(0, len(lines), 16):
            got = self.words.encode_batch_fast(lines[at : at + 16], add_special_tokens=False)
            counts = [np.diff(np.flatnonzero(self.ends_word[e.ids]) + 1, prepend=0) for e in got]
            self.known.update(zip(words[512 * at : 512 * (at + 16)], np.concatenate(counts).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        return [sum(map(self.known.__getitem__, p)) for p in self._parts(texts)]

    def _word_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where words end, and the tokens up to there."""
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(encoded.ids, np.int64)
        ends = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 1]
        last = np.diff(ends, append=len(text) + 1) > 0  # one letter may become two words, which end at one place
        at = np.flatnonzero(self.ends_word[ids] & last)
        return ends[at], at + 1

    def window(self, text: str, is_last: bool, zone: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens of a window; where words safely end within `zone` letters of its start or end, and the tokens up to there."""
        parts = self._parts([text])[0]  # one letter stands between two parts
        n = np.array([self.known[p] for p in parts], np.int64)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        before = np.cumsum(n) - n
        stops = np.append(starts[1:] - 1, len(text))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in np.flatnonzero((n > 0) & ((starts <= zone) | (stops >= len(text) - zone))).tolist():
            ends, tokens = self._word_ends(parts[k])
            found.append((ends + starts[k], tokens + before[k]))
        ends, tokens = map(np.concatenate, zip(*found))
        uniting, limit = _uniting(), len(text) - (0 if is_last else self.margin)
        safe = np.array([e < limit and text[e] not in uniting for e in ends.tolist()], bool)
        return int(n.sum()), ends[safe], tokens[safe]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker and file."""
    return Counter(path)


def _first_pass(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """uid, doc_id, n_bytes, n_tokens and text, of which one is null: the text of all but the huge, the count of those."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    schema = with_fields(docs.select("doc_id").schema, "uid long, n_bytes long, n_tokens long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for a, b in text_spans(batch["text"], 1 << 19):
                column = pc.fill_null(batch["text"].slice(a, b - a), "")
                texts = strings(column)
                usual = [k for k, t in enumerate(texts) if len(t) <= chunk]
                n: list[int | None] = [None] * len(texts)
                for k, got in zip(usual, own.counts([texts[k] for k in usual]), strict=True):
                    n[k] = got
                kept = [t if got is None else None for t, got in zip(texts, n, strict=True)]
                columns = [batch["doc_id"].slice(a, b - a), batch["uid"].slice(a, b - a), pc.cast(pc.binary_length(column), pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n_bytes", "n_tokens", "text"])

    return rows.mapInArrow(run, schema)


def _windows(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """uid, k, n, at, text: windows of huge texts. Window k starts at letter `at`; cut k lies at k * chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch["uid"].to_pylist(), strings(batch["text"]), strict=True):
                n = max(1, -(-len(text) // chunk))
                for k in range(n):
                    at = max(0, k * chunk - overlap)
                    part = text[at : (k + 1) * chunk + overlap if k < n - 1 else len(text)]
                    yield pa.RecordBatch.from_pydict({"uid": [uid], "k": [k], "n": [n], "at": [at], "text": [part]})

    return huge.select("uid", "text").mapInArrow(run, "uid long, k long, n long, at long, text string")


def _ends(windows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """uid, cut, side, ends, before, n_tokens: for each window a row for each cut it touches (the places in the overlap where
    words end and the tokens before them) and, for the last one, a row without a cut that has its count."""
    schema = "uid long, cut long, side string, ends array<long>, before array<long>, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k, is_last = row["k"], row["k"] == row["n"] - 1
                n, ends, before = own.window(row["text"], is_last, 2 * overlap)
                ends = ends + row["at"]
                if is_last:
                    out.append((row["uid"], None, None, [], [], n))
                for cut, side in [(k, "right")] * (k > 0) + [(k + 1, "left")] * (not is_last):
                    near = np.flatnonzero(np.abs(ends - cut * chunk) <= overlap)
                    out.append((row["uid"], cut, side, ends[near].tolist(), before[near].tolist(), None))
            names = ["uid", "cut", "side", "ends", "before", "n_tokens"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return windows.repartition("uid", "k").mapInArrow(run, schema)


def _spliced(ends: DataFrame) -> DataFrame:
    """uid and n_tokens, null where a cut has no place at which both sides end a word."""
    side = lambda name, what: F.max(F.when(F.col("side") == name, F.col(what)))
    cuts = ends.groupBy("uid", "cut").agg(*[side(s, w).alias(f"{s}_{w}") for s in ("left", "right") for w in ("ends", "before")], F.max("n_tokens").alias("n_tokens"))
    place = F.array_min(F.array_intersect("left_ends", "right_ends"))
    before = lambda s: F.element_at(f"{s}_before", F.array_position(f"{s}_ends", F.col("place")).cast("int"))
    found = F.when(F.col("cut").isNull(), F.col("n_tokens")).when(F.col("place").isNotNull(), before("left") - before("right"))
    added = cuts.withColumn("place", place).withColumn("added", found)
    total = F.when(F.count("added") == F.count(F.lit(1)), F.sum("added"))
    return added.groupBy("uid").agg(total.alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row of docs.

    path: a file of the tokenizers library whose model marks word ends, else ValueError. No begin, end or further tokens are
    added; the strings of added tokens in a text are these tokens, as the library has it. Null and empty texts have no tokens.
    Every row counts for itself, repeated ones, those of one doc_id and those without one. Columns other than doc_id and text
    are not read. An empty table gives an empty table. Texts of more than `chunk` letters are cut.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("overlaps must be shorter than half a chunk")
    first = written(_first_pass(docs, path, chunk), "token-counts")
    huge = first.filter("n_tokens is null").select("uid", "text")
    counted, longest = [], huge.agg(F.max(F.char_length("text"))).first()[0] or 0
    while longest:
        ends = _ends(_windows(huge, chunk, overlap), path, chunk, overlap)
        spliced = written(_spliced(ends), "spliced-counts")
        counted.append(spliced.filter("n_tokens is not null"))
        if chunk >= longest or spliced.filter("n_tokens is null").isEmpty():
            break
        huge = huge.join(spliced.filter("n_tokens is null").select("uid"), "uid", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = first.select("uid", "doc_id", "n_bytes", "n_tokens")
    if counted:
        later = functools.reduce(DataFrame.unionByName, counted).withColumnRenamed("n_tokens", "n_spliced")
        out = out.filter("n_tokens is not null").unionByName(
            out.filter("n_tokens is null").drop("n_tokens").join(later, "uid").withColumnRenamed("n_spliced", "n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
