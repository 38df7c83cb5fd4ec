"""Fills: last and next observation, interpolation, climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Prev / next observed value with its distance, NULL beyond the ends. Structs are built of observed rows only."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    prev = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("_p", prev).withColumn("_n", nxt)
    return out.select(
        *df.columns,
        F.col("_p.v").alias("prev"),
        (F.col(order) - F.col("_p.o")).alias("age"),
        F.col("_n.v").alias("next"),
        (F.col("_n.o") - F.col(order)).alias("ahead"),
    )


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, limit: int | None = None, edges: bool = False) -> DataFrame:
    """Linear between observations; `limit` fills the first cells of each gap only; `edges` holds the ends."""
    near = neighbours(df, keys, order, value)
    inside = F.col("prev") + (F.col("next") - F.col("prev")) * F.col("age") / (F.col("age") + F.col("ahead"))
    between = F.when(F.col("age") + F.col("ahead") == 0, F.col(value)).otherwise(inside)
    if limit is not None:
        between = F.when(F.col("age") <= limit, between)
    return near.withColumn("filled", F.coalesce(value, between, "prev", "next") if edges else F.coalesce(value, between))


def deviation_carry(df: DataFrame, keys: list[str], order: str, value: str, expected: str) -> DataFrame:
    """What the observations before and after a cell say of it, its own value left aside: columns line and carried.

    line is linear between the last observation before and the first after it, or the one that is there. carried is the cell's
    expected value plus the mean of how far the two lie from their own expected values; a neighbour without an expected value
    says nothing, and without any neighbour that does, or without an expected value of the cell, carried is NULL. Places are
    numbers of order, so gaps need no rows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(expected).alias("e")))
    prev = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = df.withColumns({"_p": prev, "_n": nxt})
    share = (F.col(order) - F.col("_p.o")) / (F.col("_n.o") - F.col("_p.o"))
    line = F.coalesce(F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v")), F.col("_p.v"), F.col("_n.v"))
    off = [F.col(f"{side}.v") - F.col(f"{side}.e") for side in ("_p", "_n")]
    mean = F.coalesce((off[0] + off[1]) / 2, off[0], off[1])
    return out.withColumns({"line": line, "carried": F.col(expected) + mean}).drop("_p", "_n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """J11, sparse: for each row of left the last value of right at or before it, and how long before; no spine.

    Both sides are put together and one window runs over them: one shuffle on the keys.
    """
    both = left.select(*keys, order, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*keys, order, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when((F.col("_side") == 0) & F.col("_v").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_v").alias("v")))
    out = both.withColumn("_s", F.last(seen, ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", F.col("_s.v").alias("as_of"), (F.col(order) - F.col("_s.o")).alias("as_of_age"))


def climatology(df: DataFrame, keys: list[str], phase: str, value: str, cycle: int) -> DataFrame:
    """Mean by key and phase, 0 for phases without values, smoothed (1, 2, 1) / 4 around the cycle.

    The neighbours come from three rows for each mean, added up: no window could go around the cycle's end.
    """
    means = df.groupBy(*keys, phase).agg(F.avg(value).alias("m"))
    dense = means.select(*keys).distinct().withColumn(phase, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cycle - 1).cast("long"))))
    shifted = means.filter("m is not null").select(
        *keys, F.explode(F.array(*[F.struct(F.pmod(F.col(phase) + d, F.lit(cycle)).cast("long").alias("to"), F.lit(w).alias("w")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])).alias("s"), "m"
    )
    smooth = shifted.groupBy(*keys, F.col("s.to").alias(phase)).agg(F.sum(F.col("m") * F.col("s.w")).alias("clim"))
    return dense.join(smooth, [*keys, phase], "left").withColumn("clim", F.coalesce("clim", F.lit(0.0)))


def shrunken_rate(df: DataFrame, keys: list[str], cls: str, fold: str, value: str, alpha: float = 5.0) -> DataFrame:
    """Rate by key, class and excluded fold, drawn to the key's rate over all classes; own fold = total minus own sums, in one pass."""
    own = df.groupBy(*keys, cls, fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    by_class, by_key = Window.partitionBy(*keys, cls), Window.partitionBy(*keys, fold)
    total = Window.partitionBy(*keys)
    out = own.select(
        *keys, cls, fold,
        (F.sum("s").over(by_class) - F.col("s")).alias("s_class"),
        (F.sum("n").over(by_class) - F.col("n")).alias("n_class"),
        (F.sum("s").over(total) - F.sum("s").over(by_key)).alias("s_all"),
        (F.sum("n").over(total) - F.sum("n").over(by_key)).alias("n_all"),
    )
    everywhere = F.when(F.col("n_all") > 0, F.col("s_all") / F.col("n_all")).otherwise(0.0)
    return out.select(*keys, cls, fold, ((F.col("s_class") + alpha * everywhere) / (F.col("n_class") + alpha)).alias("rate"))
