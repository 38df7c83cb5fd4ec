"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelworks.sources.files import scratch

#: A key is hot if it has more than 1 / SHARE of a table's rows, so a table has at most SHARE hot keys; none under HOT_ROWS.
SHARE, HOT_ROWS = 400, 2000
#: Tasks that the rows of a hot key are dealt to.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here, and a lost executor loses no rows of it."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys of df that one task could not hold well: at most SHARE of them, found by a count with partial sums."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    least = max(HOT_ROWS, (found["all"] or 0) // SHARE)
    if (found["most"] or 0) <= least:
        return []
    return [r[0] for r in counts.filter((F.col("_n") > least) & F.col(key).isNotNull()).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, deal: Column | None = None) -> DataFrame:
    """left joined to right, which has one row a key at most; the rows of a hot key of left are dealt to SALTS tasks.

    The rows of right for the hot keys, SHARE at most, go to each of these tasks. `hot` saves the count where the hot keys
    are known; `deal` is the number by which rows are dealt, a hash of all columns of left unless given.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot, none = F.col(key).isin(hot), F.lit(0)
    number = F.xxhash64(*left.columns) if deal is None else deal
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(number, F.lit(SALTS)).cast("int")).otherwise(none))
    spread = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(none, F.lit(SALTS - 1))).otherwise(F.array(none))))
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def with_fields(schema: StructType, fields: str) -> StructType:
    """schema and further fields, given as DDL; names of the schema may hold any character."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])


def text_spans(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text, so that working arrays stay small; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, len(size)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def strings(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()
