"""Set decoders: from probabilities along an axis to predicted sets, one window each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], p: str, ties: list[str]) -> DataFrame:
    """Rows with their place by falling p, the sum of p up to it, and the expected overlap of the set that ends there."""
    k = Window.partitionBy(*keys)
    w = k.orderBy(F.col(p).desc(), *ties)
    out = df.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("total", F.sum(p).over(k)).withColumn("expected", F.round(F.col("cum") / (F.col("rn") + F.col("total") - F.col("cum")), 9))


def expected_top(df: DataFrame, keys: list[str], p: str, ties: list[str], cap: int | None = None, power: float = 1.0, scale: float = 1.0) -> DataFrame:
    """The top set of largest expected overlap, the smallest on a tie, `cap` rows at most; power and scale change p first."""
    q = df if power == scale == 1 else df.withColumn(p, F.least(F.pow(F.col(p), F.lit(power)) * scale, F.lit(1.0)))
    r = ranked(q, keys, p, ties)
    if cap:
        r = r.filter(F.col("rn") <= cap)
    best = F.max_by("rn", F.struct("expected", (-F.col("rn")).alias("o"))).over(Window.partitionBy(*keys))
    return r.withColumn("_m", best).filter("rn <= _m").drop("_m", "cum", "total")


def threshold(df: DataFrame, keys: list[str], p: str, cut: float) -> DataFrame:
    """Rows at the cut or over; where there is none, the first largest."""
    w = Window.partitionBy(*keys).orderBy(F.col(p).desc(), "link")
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col(p) >= cut) | (F.col("_n") == 1)).drop("_n")


def _prefix(df: DataFrame, keys: list[str], pos: str, p: str) -> DataFrame:
    """Each window as an array of p by position; a window's axis is bounded, and pos is 0, 1, 2, ..."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, p))), lambda x: x[p]).alias("ps"))


def expected_range(df: DataFrame, keys: list[str], pos: str, p: str, most: int = 60, end: str | None = None) -> DataFrame:
    """The contiguous range of largest expected overlap, at most `most` long; the shortest and then first on a tie.

    K06 with `end`: ranges that end at the column's position only. Prefix sums and ranges are arrays within the window's
    row, so no pairs of rows are joined.
    """
    w = _prefix(df, keys, pos, p)
    if end:
        w = w.join(df.select(*keys, end).distinct(), keys)
    total = F.aggregate("ps", F.lit(0.0), lambda a, x: a + x)
    prefix = F.aggregate("ps", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    w = w.withColumn("total", total).withColumn("c", prefix).withColumn("n", F.size("ps"))
    ranges = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most))),
            lambda size: F.transform(
                F.sequence(F.lit(0), F.col("n") - size),
                lambda a: F.struct(
                    (-F.round((F.col("c")[a + size] - F.col("c")[a]) / (size + F.col("total") - (F.col("c")[a + size] - F.col("c")[a])), 9)).alias("e"),
                    size.alias("size"),
                    a.alias("a"),
                ),
            ),
        )
    )
    if end:
        # with the end fixed, the first of equal ones begins earliest
        best = F.array_min(F.transform(F.filter(ranges, lambda r: r["a"] + r["size"] - 1 == F.col(end)), lambda r: F.struct(r["e"].alias("e"), r["a"].alias("a"), r["size"].alias("size"))))
    else:
        best = F.array_min(ranges)
    return w.select(*keys, best.alias("b")).select(*keys, F.col("b.a").cast("long").alias("first"), (F.col("b.a") + F.col("b.size") - 1).cast("long").alias("last"), (-F.col("b.e")).alias("expected"))


def clusters(df: DataFrame, keys: list[str], pos: str, p: str, low: float, gap: int = 1) -> DataFrame:
    """Clusters of rows with p >= low and at most `gap` rows between; mass over the whole span, size, and whether it is the heaviest."""
    from panelworks.operators.runs import runs

    spans = runs(df.withColumn("_f", F.col(p) >= low), keys, pos, "_f", gap=gap)
    covered = spans.select(*keys, "run", "run_start", "run_end", F.explode(F.sequence("run_start", "run_end")).alias(pos))
    full = covered.join(df.select(*keys, pos, p), [*keys, pos]).groupBy(*keys, "run", "run_start", "run_end").agg(F.round(F.sum(p), 9).alias("mass"), F.max(p).alias("peak"))
    k = Window.partitionBy(*keys)
    top = F.row_number().over(k.orderBy(F.col("mass").desc(), "run_start")) == 1
    return full.withColumns({"top": top, "n_clusters": F.count(F.lit(1)).over(k), "place": F.row_number().over(k.orderBy(F.col("mass").desc(), "run_start"))})


def site(df: DataFrame, keys: list[str], pos: str, p: str, low: float, ratio: float | None = None) -> DataFrame:
    """expected_top inside the heaviest cluster; the second joins if its mass is at least ratio of the first's. Without a cluster: the first largest row."""
    c = clusters(df, keys, pos, p, low)
    first = F.max(F.when(F.col("place") == 1, F.col("mass"))).over(Window.partitionBy(*keys))
    chosen = c.withColumn("_m", first).filter((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("mass") >= (ratio or 1e18) * F.col("_m"))))
    inside = chosen.select(*keys, F.explode(F.sequence("run_start", "run_end")).alias(pos)).join(df, [*keys, pos])
    lone = df.join(c.select(*keys).distinct(), keys, "left_anti")
    lone = lone.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(p).desc(), pos))).filter("_n = 1").drop("_n")
    return expected_top(inside.unionByName(lone.select(*inside.columns)), keys, p, [pos])


def best_range_of_sets(truth: DataFrame, group: list[str], row: str, pos: str, axis: int) -> DataFrame:
    """For each group the contiguous range of largest mean overlap with its truth sets; the first by begin, then end, on a tie.

    truth: (group, row, pos) for each cell of each set; positions 0 .. axis - 1. Each set meets each range once, as an array.
    """
    sets = truth.groupBy(*group, row).agg(F.collect_set(pos).alias("s"))
    prefix = F.transform(F.sequence(F.lit(0), F.lit(axis)), lambda x: F.size(F.filter("s", lambda y: y < x)))
    ranges = sets.withColumn("c", prefix).withColumn("n", F.size("s")).select(
        *group, F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(axis - 1)), lambda a: F.transform(F.sequence(a, F.lit(axis - 1)), lambda b: F.struct(
            a.alias("a"), b.alias("b"), ((F.col("c")[b + 1] - F.col("c")[a]) / (b - a + 1 + F.col("n") - (F.col("c")[b + 1] - F.col("c")[a]))).alias("iou")))))).alias("r")
    )
    means = ranges.groupBy(*group, F.col("r.a").alias("a"), F.col("r.b").alias("b")).agg(F.round(F.avg("r.iou"), 9).alias("m"))
    best = means.groupBy(*group).agg(F.min(F.struct((-F.col("m")).alias("m"), "a", "b")).alias("x"))
    return best.select(*group, F.col("x.a").cast("long").alias("first"), F.col("x.b").cast("long").alias("last"), (-F.col("x.m")).alias("mean_iou"))


def best_extent(heads: DataFrame, group: list[str], most: int, least_rows: int) -> DataFrame:
    """The extent k (1..most) with the largest mean of min / max of k and the true size, for groups of enough rows."""
    tried = heads.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))))
    rated = tried.groupBy(*group, "k").agg(F.round(F.avg(F.least("k", "size") / F.greatest("k", "size")), 9).alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows)
    best = rated.groupBy(*group).agg(F.max_by(F.struct("k", "r", "n"), F.struct("r", (-F.col("k")).alias("o"))).alias("b"))
    return best.select(*group, F.col("b.k").alias("extent"), F.col("b.r").alias("mean_ratio"), F.col("b.n").alias("n"))


def pool(df: DataFrame, keys: list[str], score: str, ties: list[str], k: int, beta: float) -> DataFrame:
    """Maximum, mean, mean of the top k, and softmax-weighted mean of a group's scores."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    r = df.withColumn("_n", F.row_number().over(w))
    weight = F.exp(beta * F.col(score))
    return r.groupBy(*keys).agg(
        F.max(score).alias("pool_max"), F.avg(score).alias("pool_mean"),
        F.avg(F.when(F.col("_n") <= k, F.col(score))).alias("pool_top"), (F.sum(weight * F.col(score)) / F.sum(weight)).alias("pool_soft"),
    )


def segment_softmax(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Softmax within a segment, shifted by its maximum."""
    k = Window.partitionBy(*keys)
    return df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(k))).withColumn("softmax", F.col("_e") / F.sum("_e").over(k)).drop("_e")
