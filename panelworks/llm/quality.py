"""Quality rules: counts of a text's words and lines, and repetition from suffix arrays.

The suffix array is over words, by prefix doubling, for many texts at once; texts without any eight words that come
again need none. Of each suffix the longer one of the common prefixes with its two neighbours in the array is the depth of
the deepest prefix interval that it lies in, so the spans of these are the union of all maximal repeated substrings, and the
longest of them is the longest repeat. The words' characters in that union and the longest repeat are held against limits.

A text is worked on as a whole: its arrays take about 100 bytes a word, and 8 more for each doubling of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelworks.llm.common import strings, text_spans, with_fields

MIN_WORDS = 20
#: A repeat counts from so many words on.
REPEAT_WORDS = 8
MAX_BASE_PERCENT = 30
#: Of the characters of a text's words, those in repeats; and the words of the longest repeat against the text's words.
MAX_COVERED = 0.25
MAX_LONGEST = 0.20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys in their order, and how often each rank occurs."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.diff(starts, append=len(key))


def _suffix_array(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all texts in order, each ending with its text, and the common prefix of each with the next, in words."""
    n = len(words)
    ends = np.searchsorted(texts, texts, side="right")
    rank, often = _dense(texts.astype(np.int64) * (int(words.max()) + 1) + words)
    levels, width = [rank], 1
    while len(often) < n:
        at = np.arange(n) + width
        follow = np.where(at < ends, rank[np.minimum(at, n - 1)] + 1, 0)  # an ended suffix comes first
        rank, often = _dense(rank * (n + 1) + follow)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a + same + (1 << k) <= ends[a]) & (b + same + (1 << k) <= ends[b])
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        same += (fits & (levels[k][x] == levels[k][y])) << k
    return order, same


def repeats(words: np.ndarray, texts: np.ndarray, n_texts: int, sizes: np.ndarray, least: int = REPEAT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in repeats of `least` (a power of two) words or more, their characters, and the words of its longest repeat.

    words: word numbers of all texts, in order; texts: the text of each word, ascending; sizes: characters of each word number.
    """
    covered, chars, longest = (np.zeros(n_texts, np.int64) for _ in range(3))
    n = len(words)
    if not n:
        return covered, chars, longest
    ends = np.searchsorted(texts, texts, side="right")
    # places whose `least` words occur again in their text; the others drop out while the words double
    full = np.full(n, -1, np.int64)
    live, width, key = np.arange(n), 1, texts.astype(np.int64) * (int(words.max()) + 1) + words
    while len(live):
        rank, often = _dense(key)
        again = often[rank] > 1
        full[:] = -1
        full[live[again]] = rank[again]
        live = live[again]
        if width == least:
            break
        live = live[live + 2 * width <= ends[live]]
        live = live[full[live + width] >= 0]
        key, width = full[live] * n + full[live + width], 2 * width
    if not len(live):
        return covered, chars, longest
    with_repeats = np.zeros(n_texts, bool)
    with_repeats[texts[live]] = True
    some = with_repeats[texts]
    words, texts = words[some], texts[some]
    order, same = _suffix_array(words, texts)
    reach = np.zeros(len(order), np.int64)  # of each place: its longest match with another
    reach[order[1:]] = same
    reach[order[:-1]] = np.maximum(reach[order[:-1]], same)
    keep = np.flatnonzero(reach >= least)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, keep, 1)
    np.add.at(change, keep + reach[keep], -1)
    inside = np.cumsum(change[:-1]) > 0
    np.add.at(covered, texts[inside], 1)
    np.add.at(chars, texts[inside], sizes[words[inside]])
    np.maximum.at(longest, texts[keep], reach[keep])
    return covered, chars, longest


def measure(values: list[str]) -> dict[str, np.ndarray]:
    """All counts of the texts, as arrays."""
    counts, flat, chars, symbols, dup_lines = [], [], [], [], []
    for text in values:
        data = text.encode()
        own = data.split()  # splits at the ASCII white space of the rules and nothing else
        flat += own
        counts.append(len(own))
        symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
        chars.append(len(text) - (len(data) - len(data.translate(None, SPACES))))
        lines = [x for x in data.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(x, len(number)) for x in flat), np.int64, len(flat))
    n_words = np.array(counts, np.int64)
    sizes = np.fromiter((len(x.decode()) for x in number), np.int64, len(number))
    covered, repeated, longest = repeats(words, np.repeat(np.arange(len(values)), n_words), len(values), sizes)
    return {"n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": covered, "repeat_chars": repeated, "longest_repeat": longest}


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, repeat_chars long, longest_repeat long, covered double, kept boolean"


def score(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """All columns of docs, the measures of each whole text, and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not that, at most
    `max_covered` of the words' characters in repeats, the longest repeat at most `max_longest` of the words. Null and empty texts
    have no words and fail. Rows stay apart, repeated ones too; columns of docs with a measure's name are replaced.
    """
    measures = [x.split()[0] for x in MEASURES.split(", ")]
    docs = docs.drop(*measures)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_spans(batch[text]):
                part = batch.slice(a, b - a)
                m = measure(strings(part[text]))
                n, covered = m["n_words"], m["n_repeat_words"]
                m["base_failed"] = (n < MIN_WORDS) | (100 * covered > MAX_BASE_PERCENT * n)
                m["covered"] = m["repeat_chars"] / np.maximum(m["word_chars"], 1)
                m["kept"] = ~m["base_failed"] & (m["repeat_chars"] <= max_covered * m["word_chars"]) & (m["longest_repeat"] <= max_longest * n)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[c]) for c in measures)], [*names, *measures])

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, with_fields(plain.schema, MEASURES)).toDF(*docs.columns, *measures)
