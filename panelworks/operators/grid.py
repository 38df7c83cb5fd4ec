"""Grids: dense spines over observed keys, folds, masks, axis geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(df: DataFrame, keys: list[str], order: str, first: int, last: int) -> DataFrame:
    """Every key of df with every number of `order` from first to last. Only keys are shuffled; numbers are exploded."""
    return df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias(order))


def densify(df: DataFrame, keys: list[str], order: str, first: int, last: int) -> DataFrame:
    """Df on the spine, NULL where it has no row."""
    return spine(df, keys, order, first, last).join(df, [*keys, order], "left")


def group_fold(df: DataFrame, group: str, folds: int) -> DataFrame:
    """P05 (documented change: a hash order in place of a random shuffle): groups in md5 order dealt to folds in turn."""
    groups = df.select(group).distinct().withColumn("_h", F.md5(F.col(group).cast("string"))).withColumn("_part", F.substring("_h", 1, 3))
    # places by ranges of the hash, 4,096 at most, and what the ranges before hold
    parts = groups.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", group)) - 1
    ranked = groups.join(before, "_part").select(group, (place % folds).cast("long").alias("fold"))
    return df.join(ranked, group)


def blackout(df: DataFrame, origins: DataFrame, key: str, slot: str, value: str, truth: str, ahead: int, back: int) -> DataFrame:
    """Value NULL in the slots T+1..T+ahead of an origin T, truth put in where value misses in T-back..T-1.

    Origins are exploded to the slots that they touch, so the join is on equal keys.
    """
    touched = origins.select(key, F.explode(F.sequence(-F.lit(back), F.lit(ahead))).alias("_d"), F.col("origin")).filter("_d <> 0")
    touched = touched.select(key, (F.col("origin") + F.col("_d")).alias(slot), (F.col("_d") > 0).alias("_ahead"))
    marks = touched.groupBy(key, slot).agg(F.bool_or("_ahead").alias("_dark"), F.bool_or(~F.col("_ahead")).alias("_history"))
    out = df.join(marks, [key, slot], "left")
    shown = F.when(F.coalesce("_dark", F.lit(False)), None).when(F.coalesce("_history", F.lit(False)), F.coalesce(value, truth)).otherwise(F.col(value))
    return out.withColumn("masked", shown).drop("_dark", "_history")


def reverse_axis(df: DataFrame, keys: list[str], pos: str, length: str) -> DataFrame:
    """Positions counted from the other end, with cumulative length before each in both directions."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    down = w.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        (F.max(pos).over(w) - F.col(pos)).alias("pos_rev"),
        F.coalesce(F.sum(length).over(up), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum(length).over(down), F.lit(0.0)).alias("before_rev"),
    )
