"""Line deduplication by a tree of line templates.

A line's tokens with a digit become fields, if at least half of its tokens have none; other lines, such as rows of a
table, are compared by their own text alone. The tree has a fixed depth: the number of tokens, then the leading tokens; a
leaf holds templates. A line joins the first template of its leaf that it differs from in few enough places, which then
become fields too; else it founds one. Lines of which none may become a field are templates by themselves and need no
leaf. A template that recurs in enough documents is boilerplate: its lines stay in the document with the smallest doc_id
and are dropped from all others. A passage, a line of 50 tokens or more, recurs from two documents on, a line of one or two
tokens from twenty.

Lines are counted within each task before they are dealt to leaves, so a line of very many documents is a row a task. A
leaf is grown in one task, which holds the templates of that leaf.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import HOT_ROWS, SHARE, skew_join, strings, text_spans, with_fields, written

FIELD = b"<*>"
#: Tokens of the tree's path below the number of tokens.
LEADING = 2
#: Shorter lines are compared by their own text, digits too.
MIN_TOKENS = 3
#: Lines from so many tokens on are passages.
LONG_TOKENS = 50
#: A template recurs from so many documents on; one of a short line; one of a passage.
MIN_DOCS, SHORT_DOCS, LONG_DOCS = 5, 20, 2
WINDOW_BYTES = 16 << 20

_DIGIT = re.compile(rb"[0-9]")
_WITH_DIGIT = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")


def fields_of(n: int) -> int:
    """Places beside the digit fields that lines of one template may differ in: a fifth of the tokens, two at most."""
    return min(2, n // 5)


def masked_lines(text: str) -> list[bytes]:
    """Each line as its tokens and fields, with single spaces; a short one, or one with more fields than tokens, as it is."""
    data = text.encode()
    lines = [b" ".join(x.split()) for x in data.split(b"\n")]
    if not _DIGIT.search(data):
        return lines
    out = []
    for line in lines:
        masked, n = _WITH_DIGIT.subn(FIELD, line)
        tokens = line.count(b" ") + 1
        out.append(line if 2 * n > tokens or tokens < MIN_TOKENS else masked)
    return out


def joins_others(line: bytes, n_tokens: int) -> bool:
    """Whether a masked line may become a template with other lines."""
    return fields_of(n_tokens) > 0 and _DIGIT.search(line) is None


def line_key(masked: bytes) -> bytes | None:
    """What tells masked lines apart; None for those without a token."""
    return xxhash.xxh3_128_digest(masked) if masked else None


LINES = "n_tokens int, path binary, line binary, n_docs long"


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct masked lines of a window of documents, with the documents of each."""
    counts: dict[bytes, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal counts, size
        lines = list(counts)
        sizes = [x.count(b" ") + 1 for x in lines]
        paths = [b" ".join(x.split(b" ", LEADING)[:LEADING]) if joins_others(x, n) else xxhash.xxh3_64_digest(x) for x, n in zip(lines, sizes, strict=True)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(sizes, pa.int32()),
                pa.array(paths, pa.binary()),
                pa.array(lines, pa.binary()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["n_tokens", "path", "line", "n_docs"],
        )
        counts, size = {}, 0
        return out

    for batch in batches:
        for a, b in text_spans(batch["text"]):
            for text in strings(batch["text"].slice(a, b - a)):
                for line in set(masked_lines(text)):
                    if line:
                        if line not in counts:
                            size += len(line)
                        counts[line] = counts.get(line, 0) + 1
            if size > WINDOW_BYTES:
                yield flush()
    if counts:
        yield flush()


class Leaf:
    """The templates below one path of the tree. Lines must come in a fixed order."""

    def __init__(self, n_tokens: int):
        self.fields = fields_of(n_tokens)
        self.templates: list[list] = []  # [tokens, fields so far, documents, (key, documents) of its lines]
        self.by_part: dict[tuple, list[int]] = {}

    def _parts(self, tokens: list[bytes]) -> list[tuple]:
        """One part more than fields: two lines that differ in no more places than fields share one."""
        rest, n = tokens[LEADING:], self.fields + 1
        cuts = [len(rest) * k // n for k in range(n + 1)]
        return [(k, *rest[cuts[k] : cuts[k + 1]]) for k in range(n)]

    def add(self, line: bytes, n_docs: int) -> None:
        tokens, own = line.split(b" "), (line_key(line), n_docs)
        parts = self._parts(tokens)
        for k in dict.fromkeys(k for p in parts for k in self.by_part.get(p, ())):
            template = self.templates[k]
            differ = [i for i, (x, y) in enumerate(zip(template[0], tokens, strict=True)) if x is not None and x != y]
            if template[1] + len(differ) <= self.fields:
                for i in differ:
                    template[0][i] = None
                template[1] += len(differ)
                template[2] += n_docs
                template[3].append(own)
                return
        for p in parts:
            self.by_part.setdefault(p, []).append(len(self.templates))
        self.templates.append([list(tokens), 0, n_docs, [own]])

    def recurring(self, least: int) -> Iterator[tuple[bytes, bytes, bytes, int, int]]:
        """(key of a line, key of its template, the template, `least`, documents of the line) of templates in `least` documents or more."""
        for tokens, _, n_docs, lines in self.templates:
            if n_docs >= least:
                shown = b" ".join(FIELD if x is None else x for x in tokens)
                for key, n in lines:
                    yield key, lines[0][0], shown, least, n


TREE = "key binary, template binary, shown binary, least int, n_docs long"


def _grow_tree(least_of: tuple[int, int, int]):
    usual, short, passage = least_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, last, n, out = None, None, None, 0, []

        def close() -> None:
            """The last line is complete."""
            nonlocal at, leaf
            n_tokens, _, line = last
            least = short if n_tokens < MIN_TOKENS else passage if n_tokens >= LONG_TOKENS else usual
            if not joins_others(line, n_tokens):
                if n >= least:
                    out.append(((key := line_key(line)), key, line, least, n))
                return
            if last[:2] != at:
                leave()
                at, leaf = last[:2], Leaf(n_tokens)
            leaf.add(line, n)

        def leave() -> None:
            if leaf:
                out.extend(leaf.recurring(passage if at[0] >= LONG_TOKENS else usual))

        for batch in batches:
            for *line, n_docs in zip(*(batch[c].to_pylist() for c in ("n_tokens", "path", "line", "n_docs")), strict=True):
                if line == last:
                    n += n_docs
                    continue
                if last is not None:
                    close()
                last, n = line, n_docs
            if len(out) > 10_000:
                yield _tree_batch(out)
                out = []
        if last is not None:
            close()
            leave()
        if out:
            yield _tree_batch(out)

    return run


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "template", "shown", "least", "n_docs"])


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_spans(batch["text"]):
            ids, keys = [], []
            for doc_id, text in zip(batch["doc_id"].slice(a, b - a).to_pylist(), strings(batch["text"].slice(a, b - a)), strict=True):
                own = {k for x in set(masked_lines(text)) if (k := line_key(x))}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])


def line_templates(docs: DataFrame, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(key, template, shown, least, n_docs): every masked line of a template whose lines have `least` documents or more, as counted line by line."""
    lines = docs.select("text").mapInArrow(_count_lines, LINES)
    dealt = lines.repartition("n_tokens", "path").sortWithinPartitions("n_tokens", "path", "line")
    return dealt.mapInArrow(_grow_tree((min_docs, short_docs, long_docs)), TREE)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(doc_id, keys): what each document loses. A template recurs if enough different documents hold a line of it."""
    tree = written(line_templates(docs, min_docs, short_docs, long_docs).drop("shown"), "templates")
    # lines and templates of very many documents are dealt to SALTS tasks
    frequent = lambda df, key: [r[0] for r in df.filter(F.col("n_docs") > HOT_ROWS).orderBy(F.desc("n_docs")).limit(SHARE).select(key).collect()]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_doc_keys, "doc_id long, key binary").filter(F.col("doc_id").isNotNull())
    hits = written(skew_join(found, tree.drop("n_docs"), "key", hot=frequent(tree, "key")), "template-lines")
    recurring = written(hits.groupBy("template", "least", "doc_id").agg(F.lit(1).alias("x")).groupBy("template", "least").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner")), "recurring")
    owners = recurring.filter("n_docs >= least")
    gone = skew_join(hits.drop("least"), owners.select("template", "owner"), "template", hot=frequent(owners, "template")).filter("doc_id <> owner")
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """All columns of docs, text without the lines of recurring templates, n_lines before and n_dropped.

    Lines end at \\n; a text keeps its other lines as they are. Null and empty texts have no lines to drop, null becomes
    empty. Rows of one doc_id count as one document and lose the same lines, a null doc_id neither counts nor loses any.
    Columns of docs named n_lines or n_dropped are replaced, others stay. An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, of_id = docs.columns.index("text"), names[docs.columns.index("doc_id")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_spans(batch[names[at]]):
                part = batch.slice(a, b - a)
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(strings(part[names[at]]), part["keys"].to_pylist(), strict=True):
                    lines = text.split("\n")
                    n_lines.append(len(lines))
                    if keys:
                        gone = set(keys)
                        kept = [x for x, m in zip(lines, masked_lines(text), strict=True) if line_key(m) not in gone]
                        n_dropped.append(len(lines) - len(kept))
                        texts.append("\n".join(kept))
                    else:
                        n_dropped.append(0)
                        texts.append(text)
                columns = [part[c] for c in names]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    keys = dropped_lines(docs, min_docs, short_docs, long_docs)
    plain = docs.toDF(*names)
    joined = plain.join(keys, F.col(of_id) == keys["doc_id"], "left").select(*names, "keys")
    return joined.mapInArrow(cut, with_fields(plain.schema, "n_lines long, n_dropped long")).toDF(*docs.columns, "n_lines", "n_dropped")
