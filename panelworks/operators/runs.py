"""Runs: gaps and islands, blocks, nearest blocks, clusters, gap closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_runs(df: DataFrame, keys: list[str], order: str, flag: str, gap: int = 0) -> DataFrame:
    """Rows whose flag is true, with their run's number, start, end, length, position in it and what is left.

    Flagged rows up to gap + 1 apart are one run. Only flagged rows are sorted.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap + 1).cast("int"), F.lit(1))
    marked = df.filter(F.col(flag)).withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    r = Window.partitionBy(*keys, "run")
    return marked.drop("_new").select(
        "*",
        F.min(order).over(r).alias("run_start"),
        F.max(order).over(r).alias("run_end"),
    ).withColumns(
        {
            "run_length": F.col("run_end") - F.col("run_start") + 1,
            "run_pos": F.col(order) - F.col("run_start") + 1,
            "run_left": F.col("run_end") - F.col(order) + 1,
        }
    )


def runs(df: DataFrame, keys: list[str], order: str, flag: str, gap: int = 0, **aggregates) -> DataFrame:
    """One row for each run: start, end, length, flagged rows, and further aggregates by name."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap + 1).cast("int"), F.lit(1))
    marked = df.filter(F.col(flag)).withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    out = marked.groupBy(*keys, "run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("n_flagged"), *[v.alias(k) for k, v in aggregates.items()])
    return out.withColumn("run_length", F.col("run_end") - F.col("run_start") + 1)


def overlap_match(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """For each block (run_start, run_end) of now the block of before with the largest overlap, the first on a tie; NULLs without one.

    before's blocks are exploded to the places they cover and joined on equal keys; the pairs are counted, not compared.
    """
    covered = lambda d, name: d.select(*keys, F.col("run_start").alias(f"{name}_start"), F.col("run_end").alias(f"{name}_end"), F.explode(F.sequence("run_start", "run_end")).alias("_at"))
    pairs = covered(now, "now").join(covered(before, "before"), [*keys, "_at"]).groupBy(*keys, "now_start", "before_start").agg(F.first("now_end").alias("now_end"), F.first("before_end").alias("before_end"), F.count(F.lit(1)).alias("overlap"))
    best = pairs.groupBy(*keys, "now_start").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "before_start", "before_end")).alias("b"))
    found = best.select(*keys, F.col("now_start").alias("run_start"), "b.before_start", "b.before_end", (-F.col("b.o")).alias("overlap"))
    return now.join(found, [*keys, "run_start"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))


def nearest_flag(df: DataFrame, keys: list[str], position: str, flag: str, cap: float) -> DataFrame:
    """Distance to the nearest flagged row at or after, and at or before each row, `cap` where there is none nearer."""
    w = Window.partitionBy(*keys).orderBy(position)
    at = F.when(F.col(flag), F.col(position))
    down = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col(position)
    up = F.col(position) - F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("dist_down", F.least(F.coalesce(down, F.lit(cap)), F.lit(cap))).withColumn("dist_up", F.least(F.coalesce(up, F.lit(cap)), F.lit(cap)))


def close_gaps(df: DataFrame, keys: list[str], order: str, flag: str, gap: int) -> DataFrame:
    """closed = flagged, or between two flagged rows with at most `gap` rows between them."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.when(F.col(flag), F.col(order))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("closed", F.coalesce(F.col(flag) | (after - before <= gap + 1), F.lit(False)))


def block_geometry(df: DataFrame, keys: list[str], order: str, flag: str, weight: str) -> DataFrame:
    """For each row the block that it is in, or else the next one: tail, head, length, mass; and the number of blocks."""
    blocks = runs(df, keys, order, flag, mass=F.sum(weight))
    per = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    placed = df.join(blocks.select(*keys, F.col("run_start").alias(order), "run_start", "run_end", "run_length", "mass"), [*keys, order], "left")
    w = Window.partitionBy(*keys).orderBy(order)
    block = F.when(F.col("run_start").isNotNull(), F.struct("run_start", "run_end", "run_length", "mass"))
    here = F.last(block, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(block, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = placed.withColumn("_h", here).withColumn("_l", later)
    of = F.when(F.col("_h.run_end") >= F.col(order), F.col("_h")).otherwise(F.col("_l"))
    out = out.withColumn("_b", of).select(*df.columns, F.col("_b.run_start").alias("tail"), F.col("_b.run_end").alias("head"), F.col("_b.run_length").alias("block_length"), F.col("_b.mass").alias("block_mass"))
    return out.join(per, keys, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0).cast("long")))
