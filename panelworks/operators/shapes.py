"""Set decoders that look at historical sets: head and extent, and a library of sets; and the candidate prefilter before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.decode import expected_top
from panelworks.operators.runs import runs

#: A cell is a candidate if any of its features is on the right side of its limit.
AT_MOST = {"down_now": 12.0, "up_now": 3.0, "ratio_least": 1.5, "ratio_last": 1.6, "down_before": 12.0}
AT_LEAST = {"prior": 0.02}


def is_candidate(at_most: dict[str, float] = AT_MOST, at_least: dict[str, float] = AT_LEAST) -> Column:
    """Whether a cell is near enough to anything to be worth a feature row. A null feature is on no side."""
    tests = [F.col(c) <= x for c, x in at_most.items()] + [F.col(c) >= x for c, x in at_least.items()]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def head_extent(df: DataFrame, keys: list[str], pos: str, p: str, extents: DataFrame, on: list[str], hybrid: bool = False) -> DataFrame:
    """(keys, pos) of each window's predicted set: a block below the head of its heaviest cluster.

    The clusters are those of the top set by expected overlap; the head is the last place of the heaviest one, the first
    on a tie. extents (on, head, extent) tells how long a block with that head is best. The block takes the cluster's
    place, the other clusters stay. hybrid keeps of the top set what lies in the block or a place beside it, and the other
    clusters. Windows without an extent for their head, or hybrid ones with nothing left, keep the top set.
    """
    key = list(dict.fromkeys([*keys, *on]))
    top = expected_top(df, key, p, [pos]).select(*key, pos, p).withColumn("_t", F.lit(True))
    heavy = runs(top, key, pos, "_t", mass=F.sum(p))
    best = heavy.groupBy(*key).agg(F.min(F.struct((-F.round("mass", 9)).alias("m"), "run_start", "run_end")).alias("b"))
    told = best.select(*key, F.col("b.run_start").alias("a"), F.col("b.run_end").alias("head")).join(extents.select(*on, "head", "extent"), [*on, "head"], "left")
    lo = F.greatest(F.col("head") - F.col("extent") + 1, F.lit(0))
    cells = top.select(*key, pos).join(told, key)
    own = F.col(pos).between(F.col("a"), F.col("head"))
    if hybrid:
        near = F.coalesce(F.col(pos).between(lo - 1, F.col("head") + 1), F.lit(False))
        some = F.max(near).over(Window.partitionBy(*key))
        return cells.withColumn("_n", near).withColumn("_s", some).filter(~F.col("_s") | F.col("_n") | ~own).select(*keys, pos)
    other = cells.filter(~own | F.col("extent").isNull()).select(*keys, pos)
    block = told.filter(F.col("extent").isNotNull()).select(*keys, F.explode(F.sequence(lo, F.col("head"))).alias(pos))
    return other.unionByName(block).distinct()


def held_out_extents(heads: DataFrame, group: list[str], fold: str, folds: int, most: int, least_rows: int) -> DataFrame:
    """A32 for each fold on the heads of all others: (group, fold, extent, mean_ratio, n), from counts by size, totals minus own.

    heads: (group, fold, size), one row for each true block.
    """
    counts = heads.groupBy(*group, "size", fold).agg(F.count(F.lit(1)).alias("n"))
    held = counts.withColumn("_held", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")))).filter(F.col("_held") != F.col(fold))
    tried = held.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))))
    ratio = F.least("k", "size") / F.greatest("k", "size")
    rated = tried.groupBy(*group, "_held", "k").agg(F.round(F.sum(ratio * F.col("n")) / F.sum("n"), 9).alias("r"), F.sum("n").alias("rows")).filter(F.col("rows") >= least_rows)
    best = rated.groupBy(*group, "_held").agg(F.max_by(F.struct("k", "r", "rows"), F.struct("r", (-F.col("k")).alias("o"))).alias("b"))
    return best.select(*group, F.col("_held").alias(fold), F.col("b.k").alias("extent"), F.col("b.r").alias("mean_ratio"), F.col("b.rows").alias("n"))


def library(truth: DataFrame, group: list[str], row: str, pos: str, fold: str) -> tuple[DataFrame, DataFrame]:
    """The different sets of each group, and how often each is the truth of a fold.

    truth: (group, row, pos, fold) for each cell of each set. Gives sets (group, set, pos, n) by cell, n cells each, and
    members (group, set, fold, often). A set's name is its places in order, as text.
    """
    rows = truth.groupBy(*group, row, fold).agg(F.array_sort(F.collect_set(pos)).alias("_s")).withColumn("set", F.array_join(F.col("_s").cast("array<string>"), " "))
    members = rows.groupBy(*group, "set", fold).agg(F.count(F.lit(1)).alias("often"), F.first("_s").alias("_s"))
    sets = members.groupBy(*group, "set").agg(F.first("_s").alias("_s"))
    return sets.select(*group, "set", F.size("_s").alias("n"), F.explode("_s").alias(pos)), members.drop("_s")


def library_decode(df: DataFrame, keys: list[str], group: list[str], pos: str, p: str, fold: str, sets: DataFrame, members: DataFrame, tau: float = 0.3, alpha: float = 0.7) -> DataFrame:
    """For each window the set of largest expected overlap, out of its group's library and its own top set: (keys, set, score).

    keys holds group and fold. A set's prior is how often the truth of other folds was it; its posterior that times the
    window's likelihood to the power tau. A candidate's score is alpha times its mean overlap with the library under the
    posterior, and the rest times the overlap expected if places were independent. Sets of the own fold alone are out. Of
    equal scores a library set, the first by name, goes before the top set.

    Pairs of sets are compared once for each group, by the places that they share; a window costs as many rows as its
    library has overlapping pairs.
    """
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.log(clipped) - F.log1p(-clipped)
    windows = df.groupBy(*keys).agg(F.sum(p).alias("_all"))
    told = members.withColumnRenamed(fold, "_of")
    prior = windows.join(told, group).filter(F.col("_of") != F.col(fold)).groupBy(*keys, "_all", "set").agg(F.sum("often").alias("_prior"))
    within = df.withColumn("_odds", odds).join(sets, [*group, pos]).groupBy(*keys, "set").agg(F.sum("_odds").alias("_like"), F.sum(p).alias("_p"), F.first("n").alias("n"))
    known = prior.join(within, [*keys, "set"])
    w = Window.partitionBy(*keys)
    weight = F.col("_prior") * F.exp(tau * (F.col("_like") - F.max("_like").over(w)))
    known = known.withColumn("_w", weight).withColumn("_post", F.col("_w") / F.sum("_w").over(w))
    left, right = sets.withColumnsRenamed({"set": "cand", "n": "_nc"}), sets
    shared = left.join(right, [*group, pos]).groupBy(*group, "cand", "set").agg((F.count(F.lit(1)) / (F.first("_nc") + F.first("n") - F.count(F.lit(1)))).alias("_iou"))
    top = expected_top(df, keys, p, [pos]).select(*keys, pos, p)
    top_size = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc"), F.sum(p).alias("_pt"))
    met = top.select(*keys, pos).join(sets, [*group, pos]).groupBy(*keys, "set").agg(F.count(F.lit(1)).alias("_k")).join(top_size, keys)
    post = known.select(*keys, "set", "n", "_post")
    of_top = top_size.join(windows, keys).join(
        met.join(post, [*keys, "set"]).groupBy(*keys).agg(F.sum(F.col("_post") * F.col("_k") / (F.col("_nc") + F.col("n") - F.col("_k"))).alias("_e")), keys, "left"
    ).select(*keys, F.lit("top").alias("cand"), F.lit(1).alias("_last"), F.coalesce("_e", F.lit(0.0)).alias("_e"), (F.col("_pt") / (F.col("_nc") + F.col("_all") - F.col("_pt"))).alias("_ind"))
    expected = post.join(shared, [*group, "set"]).groupBy(*keys, "cand").agg(F.sum(F.col("_post") * F.col("_iou")).alias("_e"))
    ind = F.col("_p") / (F.col("n") + F.col("_all") - F.col("_p"))
    of_sets = known.select(*keys, F.col("set").alias("cand"), ind.alias("_ind")).join(expected, [*keys, "cand"]).select(*keys, "cand", F.lit(0).alias("_last"), "_e", "_ind")
    scored = of_sets.unionByName(of_top).withColumn("score", F.round(alpha * F.col("_e") + (1 - alpha) * F.col("_ind"), 8))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "_last", "cand")).alias("b"))
    return best.select(*keys, F.col("b.cand").alias("set"), (-F.col("b.s")).alias("score"))
