"""A corpus cleaning pipeline out of the operators of panelworks.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever
the names of further ones. A document is a row: rows of one doc_id are told apart by their texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import jaccard, line_templates, packing, quality, secrets
from panelworks.llm.common import written
from panelworks.llm.queries import byte_bpe, words

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _keeps_columns(stage: Stage) -> Stage:
    """The stage on doc_id and text, with the other columns under names that no operator uses; n_chars follows the text."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: c if c in ("doc_id", "text") else f"column {k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[_column(c).alias(n) for c, n in inner.items()]), sf_dir)
        size = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
        return out.select(*[(size if c == "n_chars" else _column(n)).alias(c) for c, n in inner.items()])

    return run


@_keeps_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Whole texts are read, however long. Every row is judged alone, so repeated
    rows and rows of one doc_id stay or go each for itself. An empty table stays empty.
    """
    return quality.score(docs).filter("kept")


@_keeps_columns
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document goes if it loses lines and has no word left.

    Lines recur by the operator's own bounds: templates from five documents on, passages of 50 tokens and more from two. A
    recurring line stays in the document with the smallest doc_id; rows of that doc_id keep it all. Null texts become empty
    and stay, as they lose nothing. A null doc_id neither counts nor loses lines. An empty table stays empty.
    """
    cut = line_templates.drop_recurring_lines(docs)
    return cut.filter("n_dropped = 0" + r" or text rlike '[^\\x20\\x09-\\x0D]'")


@_keeps_columns
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and near-equal documents the row with the smallest doc_id; other documents stay.

    Rows of one doc_id are told apart by their texts: those of different groups all stay, repeated ones become one. Null
    and empty texts are equal. A null doc_id comes last; texts that only such rows have stay once each. An empty table
    stays empty.
    """
    return jaccard.drop_near_duplicates(docs)


@_keeps_columns
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; no row goes.

    Null texts become empty. Whole texts are searched; rows are masked each for itself. An empty table stays empty.
    """
    return secrets.scan_with_rules(docs, words())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left: a row for each piece of each document.

    Null and empty texts are one id, the end's. Long texts are cut into pieces. Every row is packed, repeated ones and
    those of one doc_id too; columns other than doc_id and text are not read. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", pack_stage),
]

#: Several stages are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
