"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

Texts are cut before single spaces, where the tokenizer's own pre-tokenisation always has a boundary, and each
distinct chunk is encoded once and remembered. The ids are those of encoding the whole text. Texts that hold a token
added to the tokenizer, such as <|endoftext|>, are encoded as a whole, or as plain text with `plain`.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: A space between two white-space characters: only there a cut before the space can fall inside one pre-token.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


class _Rows(dict):
    """chunk -> row; a chunk seen for the first time gets the next row and waits in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = row = len(self)
        self.fresh.append(chunk)
        return row


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _encoded(tokenizer, texts: list[str], step: int) -> Iterator[list[int]]:
    """The ids of each text; `step` texts at a time, as the library's results take much memory."""
    for at in range(0, len(texts), step):
        for got in tokenizer.encode_batch_fast(texts[at : at + step], add_special_tokens=False):
            yield got.ids


class Encoder:
    """encode() gives flat ids and the number of ids of each text. `room` bounds the chunks that are remembered.

    A chunk's key is its text; a space goes before it, but for the first chunk of a text, which has a key that starts
    with a space instead. No chunk holds a space itself.
    """

    def __init__(self, path: str, room: int = 700_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added and not plain else None
        self.tokenizer.encode_special_tokens = plain
        self.words = Tokenizer.from_file(path)  # for letters only, of which each chunk is one pre-token
        self.words.encode_special_tokens = True
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that a token stands for
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.letters = byte_letters()
        self.room = room
        self.forget()

    def forget(self) -> None:
        """Lets the remembered chunks go."""
        self.rows = _Rows()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _parts(self, key: str) -> tuple[str, ...] | None:
        """Shorter chunks that make up a chunk, where the pre-tokens surely end: before a last mark, around a line end."""
        if key[-1:] in {".", ",", "!"} and key[-2:-1].isalpha():
            return key[:-1], " " + key[-1]
        head, line, tail = key.partition("\n")
        if line and head.strip() and tail and not head[-1].isspace() and not tail[0].isspace():
            return head, " \n", " " + tail
        return None

    def _joined(self, tokenizer, pieces: list[str], widths: list[int], between: str) -> tuple[list[int], np.ndarray]:
        """Flat ids and their number for each piece, encoded many at a time; tokens are told apart by the bytes they stand for."""
        step, flat, counts = 128, [], []
        groups = [between.join(pieces[at : at + step]) for at in range(0, len(pieces), step)]
        for k, ids in enumerate(_encoded(tokenizer, groups, 64)):
            last = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(widths[k * step : (k + 1) * step])) + 1
            counts.append(np.diff(last, prepend=0))
            flat += ids
        return flat, np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _store(self, rows: np.ndarray, lengths: np.ndarray, ids) -> None:
        """The ids of some rows, one row after another."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[rows] = self.used + np.cumsum(lengths) - lengths
        self.length[rows] = lengths
        self.used += len(ids)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, and where each row's end."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self) -> None:
        """Encodes the fresh chunks: words of letters, other chunks that their spaces keep apart, and the rest one by one."""
        row, fresh = self.rows.__getitem__, self.rows.fresh
        first = len(self.rows) - len(fresh)
        words, plain, alone, made = [], [], [], {2: ([], []), 3: ([], [])}
        for k, key in enumerate(fresh):  # grows while the parts of new chunks are new themselves
            if key.isalpha():
                words.append(k)
            elif parts := self._parts(key):
                whole, rows = made[len(parts)]
                whole.append(k)
                rows += map(row, parts)
            elif key and key[0] != " " and not key[0].isspace() and not key[-1].isspace():
                plain.append(k)
            else:
                alone.append(k)
        self.rows.fresh = []
        self.start = np.concatenate([self.start, np.full(len(fresh), -1, np.int64)])
        self.length = np.concatenate([self.length, np.zeros(len(fresh), np.int64)])
        shown = ["Ġ" + (x if x.isascii() else x.encode().decode("latin-1").translate(self.letters)) for x in map(fresh.__getitem__, words)]
        ids, n = self._joined(self.words, shown, list(map(len, shown)), " ")
        self._store(first + np.array(words, np.int64), n, ids)
        spaced = [" " + fresh[k] for k in plain]
        ids, n = self._joined(self.tokenizer, spaced, [len(x.encode()) for x in spaced], "")
        self._store(first + np.array(plain, np.int64), n, ids)
        single = [x[1:] if x[:1] == " " else " " + x for x in map(fresh.__getitem__, alone)]
        got = list(_encoded(self.tokenizer, single, 4096))
        self._store(first + np.array(alone, np.int64), np.array(list(map(len, got)), np.int64), list(chain.from_iterable(got)))
        waiting = [(first + np.array(whole, np.int64), np.array(parts, np.int64).reshape(-1, n)) for n, (whole, parts) in made.items()]
        while any(len(whole) for whole, _ in waiting):  # a part may be made of parts itself
            later = []
            for whole, parts in waiting:
                ready = (self.start[parts] >= 0).all(axis=1)
                ids, _ = self._gather(parts[ready].ravel())
                self._store(whole[ready], self.length[parts[ready]].sum(axis=1), ids)
                later.append((whole[~ready], parts[~ready]))
            waiting = later

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > self.room:
            self.forget()
        rows: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        whole: dict[int, np.ndarray] = {}
        row = self.rows.__getitem__
        for k, text in enumerate(texts):
            if not text:
                continue
            if _UNSAFE.search(text) or (self.added and self.added.search(text)):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
                continue
            head, *tail = text.split(" ")
            before = len(rows)
            if head:
                rows.append(row(" " + head))
            rows.extend(map(row, tail))
            counts[k] = len(rows) - before
        if self.rows.fresh:
            self._learn()
        ids, ends = self._gather(np.array(rows, np.int64))
        id_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        n = np.diff(id_ends, prepend=0)
        if whole:
            parts = [whole.get(k, ids[e - c : e]) for k, (e, c) in enumerate(zip(id_ends, n, strict=True))]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, n


@functools.lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each Python worker and file. plain: the strings of special tokens are text like any other."""
    return Encoder(path, plain=plain)
