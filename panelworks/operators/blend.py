"""Ranks, ensembles, blends of long score tables (arm, id, target, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each different value of a key: `_same` rows have it, `_below` rows are under it, `_n` rows are there; NULL comes first.

    Rows are counted by value first; the values of a key are dealt to ranges between about PARTS quantiles, so no task sorts a
    whole key; what the ranges before hold is a sum over at most PARTS rows.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_same"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)]).alias("_cuts"), F.sum("_same").alias("_n"))
    told = counts.join(cuts, keys).withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0)))
    k = Window.partitionBy(*keys)
    before = told.groupBy(*keys, "_part").agg(F.sum("_same").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(k.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("_same").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("_within", within).join(before, [*keys, "_part"]).select(*keys, "_v", "_same", "_n", (F.col("_before") + F.col("_within")).alias("_below"))


PARTS = 64


def with_places(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with the columns of places() for its rows' values."""
    told = places(df, keys, value).withColumnsRenamed({c: f"_k_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col(value).eqNullSafe(F.col("_v"))]
    return df.join(told, on).drop("_v", *[f"_k_{c}" for c in keys])


def score_ranks(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Average-rank share, 0-1 average rank (one row: 0.5), and ordinal 0-1 rank with ties by `tie`."""
    average = F.col("_below") + (F.col("_same") + 1) / 2
    place = F.col("_below") + F.row_number().over(Window.partitionBy(*keys, score).orderBy(tie))
    n = F.col("_n")
    return with_places(df, keys, score).withColumns(
        {
            "rank_pct": average / n,
            "rank_01": F.when(n > 1, (average - 1) / (n - 1)).otherwise(0.5),
            "rank_ordinal": F.when(n > 1, (place - 1) / (n - 1)).otherwise(0.5),
        }
    ).drop("_below", "_same", "_n")


def rank_share(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """W23 alone: df with the average-rank share of value."""
    return with_places(df, keys, value).withColumn(out, (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_n")).drop("_below", "_same", "_n")


def weighted_mean(df: DataFrame, weights: DataFrame, keys: list[str], on: list[str], p: str, n_arms: int | None = None) -> DataFrame:
    """sum(w p) / sum(w) over the arms that a key has; with n_arms only keys that have them all."""
    out = df.join(weights, on).filter(F.col(p).isNotNull()).groupBy(*keys).agg((F.sum(F.col("w") * F.col(p)) / F.sum("w")).alias("blend"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") == n_arms) if n_arms else out


def fold_ensemble(df: DataFrame, member: str, fold: str, keys: list[str], target: str, p: str, folds: DataFrame, digits: int | None = None) -> DataFrame:
    """P averaged over the members of a fold, ranked within fold and target, and the ranks averaged over the folds:
    (keys, target, ensemble). With `digits` the means are rounded first, so that equal ones stay equal in any order of members.

    df (member, fold, keys, target, p); folds (fold, target, w): what a fold's ranks weigh for a target. A fold without a weight
    has no vote there. Every member of a fold must have a number for every row that the fold has a vote on, or the query fails:
    means over different members would be ranked against each other.
    """
    sizes = df.select(fold, member).distinct().groupBy(fold).agg(F.count(F.lit(1)).alias("_members"))
    known = F.when(~F.isnan(p), F.col(p))
    means = df.groupBy(fold, *keys, target).agg(F.avg(known).alias("_mean"), F.count(known).alias("_has"), F.count_distinct(member).alias("_own"))
    whole = (F.col("_has") == F.col("_members")) & (F.col("_own") == F.col("_members"))
    told = means.join(sizes, fold).join(folds.filter("w > 0"), [fold, target])
    told = told.withColumn("_mean", F.when(whole, F.col("_mean")).otherwise(F.raise_error(F.concat(F.lit("not every member has a number: fold "), F.col(fold).cast("string"))).cast("double")))
    if digits is not None:
        told = told.withColumn("_mean", F.round("_mean", digits))
    ranked = rank_share(told, [fold, target], "_mean", "_rank")
    return ranked.groupBy(*keys, target).agg((F.sum(F.col("w") * F.col("_rank")) / F.sum("w")).alias("ensemble"))


def target_mix(one: DataFrame, other: DataFrame, keys: list[str], target: str, p: str, shares: DataFrame) -> DataFrame:
    """P of one drawn to that of the other by the target's share: (keys, target, p). shares (target, w); a target without
    a share, or a row that the other lacks, stays."""
    both = one.join(other.select(*keys, target, F.col(p).alias("_other")), [*keys, target], "left").join(shares, target, "left")
    share = F.when(F.col("_other").isNotNull(), F.coalesce("w", F.lit(0.0))).otherwise(0.0)
    return both.select(*keys, target, ((1 - share) * F.col(p) + share * F.coalesce("_other", F.lit(0.0))).alias(p))


def member_mean(df: DataFrame, member: str, keys: list[str], values: list[str], members: int) -> DataFrame:
    """One table out of the members' tables: the mean of each value; all other columns must be the same in each.

    The query fails if a key is not once in every member or if another column differs, NULL being equal to NULL. A value that
    a member lacks is missing in the mean, as it would stand for the others alone; n_missing counts them.
    """
    others = [c for c in df.columns if c not in {member, *keys, *values}]
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    means = [F.when(F.count_if(gone(c)) == 0, F.avg(c)).alias(c) for c in values]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in others])
    told = df.groupBy(*keys).agg(
        *means, F.first(rest).alias("_rest"), F.count_distinct(rest).alias("_kinds"), F.count(F.lit(1)).alias("_rows"), F.count_distinct(member).alias("_of"), sum(F.count_if(gone(c)) for c in values).alias("n_missing")
    )
    same = (F.col("_rows") == members) & (F.col("_of") == members) & (F.col("_kinds") == 1)
    rest = F.when(same, F.col("_rest")).otherwise(F.raise_error(F.concat(F.lit("members differ at "), F.to_json(F.struct(*keys)))).cast(told.schema["_rest"].dataType))
    # the check stays in the plan whichever columns are read afterwards
    return told.withColumn("_rest", rest).filter("_rest is not null").select(*keys, *values, *[F.col(f"_rest.{c}").alias(c) for c in others], "n_missing")


def staged_hybrid(views: DataFrame, view_weights: DataFrame, private: DataFrame, base: DataFrame, outer: DataFrame, key: str, target: str, arm: str, p: str, share: float) -> DataFrame:
    """Views (key, target, arm, p) are averaged by view_weights (arm, w), renormalised over the views that a key has, and
    ranked; mixed with the rank of private (key, target, p) by `share`; then with the rank of base by outer (target, w); and
    ranked again: (key, target, final). Probabilities are cut to [0, 1] first."""
    cut = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    keys = [key, target]
    public = rank_share(weighted_mean(views.withColumn(p, cut), view_weights, keys, [arm], p), [target], "blend", "_public").select(*keys, "_public")
    own = rank_share(private, [target], p, "_private").select(*keys, "_private")
    first = rank_share(base, [target], p, "_base").select(*keys, "_base")
    mixed = public.join(own, keys).join(first, keys).join(outer.select(target, F.col("w").alias("_w")), target)
    hybrid = (1 - share) * F.col("_public") + share * F.col("_private")
    told = mixed.withColumn("_mix", F.round((1 - F.col("_w")) * F.col("_base") + F.col("_w") * hybrid, 10))
    return rank_share(told, [target], "_mix", "final").select(*keys, "final")


def aligned(df: DataFrame, arm: str, key: str, n_arms: int) -> DataFrame:
    """Rows of keys that every arm has."""
    full = df.groupBy(key).agg(F.count_distinct(arm).alias("_n")).filter(F.col("_n") == n_arms).select(key)
    return df.join(full, key, "left_semi")


def subset_means(df: DataFrame, members: list[str], member: str, keys: list[str], p: str) -> DataFrame:
    """The mean of every non-empty subset of members, as a bit mask; six members at most."""
    if not 0 < len(members) <= 6:
        raise ValueError("one to six members")
    bit = F.lit(0)
    for k, name in enumerate(members):
        bit = F.when(F.col(member) == name, 1 << k).otherwise(bit)
    masks = F.explode(F.sequence(F.lit(1), F.lit((1 << len(members)) - 1))).alias("mask")
    rows = df.select(*keys, p, bit.alias("_bit"), masks).filter(F.col("mask").bitwiseAND(F.col("_bit")) != 0)
    return rows.groupBy(*keys, "mask").agg(F.avg(p).alias("mean"), F.count(F.lit(1)).alias("members"))


def sessions(df: DataFrame, order: str, vector: str, least: float, keys: list[str]) -> DataFrame:
    """Consecutive rows are one session while the cosine with the row before is `least` or more."""
    w = Window.partitionBy(*keys).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = df.withColumn("_b", F.lag(vector).over(w))
    cosine = dot(F.col(vector), F.col("_b")) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("_b"), F.col("_b")))
    out = out.withColumn("cosine", F.round(cosine, 6))
    return out.withColumn("session", F.sum(F.coalesce((F.col("cosine") < least).cast("int"), F.lit(1))).over(w).cast("long")).drop("_b")


#: Different values of a key up to which its median is found in one aggregation buffer.
FEW_VALUES = 10_000


def exact_medians(df: DataFrame, keys: list[str], value: str, out: str, few: int = FEW_VALUES) -> DataFrame:
    """The median of the known values of each key, exact, without a task that sorts a whole key. NULL keys are a key.

    Values are counted first. A key of at most `few` different values has its median from an aggregation over the counts, whose
    buffer holds no more than those; the counts of a key with more are dealt to ranges, and the one or two values in the middle
    found by how many rows are under them.
    """
    grouped = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.col(value).alias("_value"))
    counts = grouped.groupBy("_g", "_value").agg(F.count(F.lit(1)).alias("_c"))
    many = counts.groupBy("_g").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > few).select("_g")
    short = counts.join(many, "_g", "left_anti").groupBy("_g").agg(F.percentile("_value", F.lit(0.5), F.col("_c")).alias(out))
    n, below, over = F.col("_n"), F.col("_below"), F.col("_below") + F.col("_same")
    at = lambda place: F.max(F.when((below <= place) & (place < over), F.col("_v")))
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return short.unionByName(places(grouped.join(many, "_g", "left_semi"), ["_g"], "_value").groupBy("_g").agg(middle.alias(out)))


def median_smooth(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(1 - share) x + share * the group's median; a table of one row a group is joined back."""
    told = df.withColumn("_g", F.struct(*keys)).join(exact_medians(df, keys, value, "_median"), "_g", "left")
    return told.withColumn("smoothed", (1 - share) * F.col(value) + share * F.col("_median")).drop("_g", "_median")
