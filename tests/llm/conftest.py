import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows, and a null id."""
    long = " ".join(f"w{k % 997}x{k % 89}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one  two three\nfour five six"), (6, long), (7, long), (None, "one two three four five six"), (8, "É ñ 漢字   x"), (9, "a" * 50_000)]
    return docs_of(rows)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty_docs(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd documents with extra columns whose names the operators use themselves."""
    names = ["kept", "n_words", "n_dropped", "n_secrets", "_keys", "slot", "shard", "node", "row", "sequence_id", "offset", "piece", "_doc_id", "keys", "_f", "_slot", "_group", "uid", "_row", "_no_id", "_salt", "text_key", "c0", "c1", "secrets", "n_candidates", "a`b", "with space"]
    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])
