"""Forecast windows: rolling statistics, selection, histories, priors, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, keys: list[str], order: str, value: str, high: float) -> DataFrame:
    """Means, extremes and counts of the 12 rows before, lagged differences, peak of 3-row means, slope of 6 rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, v = w.rowsBetween(-12, -1), F.col(value)
    out = df.withColumns(
        {
            "n12": F.count(v).over(before),
            "mean12": F.avg(v).over(before),
            "min12": F.min(v).over(before),
            "max12": F.max(v).over(before),
            "high12": F.count_if(v > high).over(before),
            "d3": v - F.lag(v, 3).over(w),
            "d11": v - F.lag(v, 11).over(w),
            "mean3": F.avg(v).over(w.rowsBetween(-2, 0)),
            "_ma3": (v + F.lag(v).over(w) + F.lag(v, 2).over(w)) / 3,
            "slope6": F.regr_slope(v, F.col(order)).over(w.rowsBetween(-5, 0)),
        }
    )
    return out.withColumn("peak_ma3", F.max("_ma3").over(w.rowsBetween(-9, 0))).drop("_ma3")


def lookahead(df: DataFrame, keys: list[str], link: str, order: str, flag: str, steps: int) -> DataFrame:
    """Per slot how many links are flagged now, how many in the next steps, and the mean overlap of now with each step."""
    w = Window.partitionBy(*keys, link).orderBy(order)
    later = {f"_a{k}": F.coalesce(F.lead(flag, k).over(w), F.lit(False)) for k in range(1, steps + 1)}
    now = F.col(flag)
    terms = []
    for k in later:
        union = F.count_if(now | F.col(k))
        terms.append(F.when(union == 0, 1.0).otherwise(F.count_if(now & F.col(k)) / union))
    anyone = F.lit(False)
    for k in later:
        anyone = anyone | F.col(k)
    return df.withColumns(later).groupBy(*keys, order).agg(F.count_if(now).alias("now"), F.count_if(anyone).alias("later"), (sum(terms[1:], terms[0]) / steps).alias("persistence_iou"))


def greedy_spaced(candidates: DataFrame, keys: list[str], order: str, condition: str | None, spacing: int, quota: int | None) -> DataFrame:
    """In order, accept what is `spacing` or more after the last accepted, at most `quota` of each value of a condition.

    Each key's candidates pass through one task in order, as each choice depends on the one before; the task holds a batch, the
    last choice and two counts, whatever the number of candidates.
    """
    flag = F.coalesce(F.col(condition), F.lit(False)) if condition else F.lit(True)
    rows = candidates.select(*keys, F.col(order).cast("long").alias("_o"), flag.alias("_c")).distinct()
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_o", "_c")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, taken = None, None, {}
        for batch in batches:
            chosen = []
            for i, (*own, o, c) in enumerate(zip(*(x.to_pylist() for x in batch.columns), strict=True)):
                if own != key:
                    key, last, taken = own, None, {True: 0, False: 0}
                if (quota is None or taken[c] < quota) and (last is None or o - last >= spacing):
                    last = o
                    taken[c] += 1
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    out = dealt.mapInArrow(accept, dealt.schema)
    return out.select(*keys, F.col("_o").alias(order), *([F.col("_c").alias(condition)] if condition else []))


def simulate(candidates: DataFrame, keys: list[str], order: str, condition: str, spacing: int, quota: int, first: int, step: int, horizon: int) -> DataFrame:
    """greedy_spaced from every `step`-th place from `first` on, over `horizon`; unique windows with the number of starts
    that draw them. A candidate is copied to the horizon / step starts that reach it, however many starts there are."""
    earliest = F.greatest(F.lit(0).cast("long"), F.floor((F.col(order) - horizon - first) / step) + 1)
    latest = F.floor((F.col(order) - first) / step)
    begun = candidates.filter(F.col(order) >= first).withColumn("_s", F.explode(F.sequence(earliest, latest)))
    drawn = greedy_spaced(begun, [*keys, "_s"], order, condition, spacing, quota)
    return drawn.groupBy(*keys, order, condition).agg(F.count(F.lit(1)).alias("draws"))


def around(origins: DataFrame, cells: DataFrame, keys: list[str], order: str, offsets: list[int]) -> DataFrame:
    """The cells at the offsets of each origin; origins are exploded, the join is on equal keys."""
    wanted = origins.withColumn("step", F.explode(F.array(*[F.lit(d).cast("long") for d in offsets]))).withColumn(order, F.col("origin") + F.col("step"))
    return wanted.join(cells, [*keys, order])


def similar_prior(
    origins: DataFrame, truth: DataFrame, keys: list[str], origin: str, phase: str, fold: str, reach: int | None, least: int, same: list[str] | None = None
) -> DataFrame:
    """Mean truth of each cell over windows of other folds whose phase is within reach; NULL for fewer than `least`.

    reach None: whatever their phase. same: columns of origins, a class of weekdays say, in which the windows must be equal.
    Sums by phase and fold come first, so windows are never paired with windows: a window meets the phases in its reach.
    """
    alike = [*keys, *(same or [])]
    at = F.lit(0) if reach is None else F.col(phase)
    own = truth.join(origins, [*keys, origin]).groupBy(*alike, at.alias("_phase"), F.col(fold).alias("_fold"), "link").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    near = origins.withColumn("_phase", F.lit(0) if reach is None else F.explode(F.sequence(F.col(phase) - reach, F.col(phase) + reach)))
    met = near.join(own, [*alike, "_phase"]).filter(F.col(fold) != F.col("_fold"))
    return met.groupBy(*keys, origin, "link").agg(F.sum("n").alias("n_similar"), F.when(F.sum("n") >= least, F.sum("s") / F.sum("n")).alias("prior"))


def neighbour_max(df: DataFrame, keys: list[str], link: str, value: str, out: str) -> DataFrame:
    """The largest value of a cell and the cells beside it on the axis; NULLs are passed over, the ends have one neighbour."""
    beside = Window.partitionBy(*keys).orderBy(link).rangeBetween(-1, 1)
    return df.withColumn(out, F.max(value).over(beside))


def expand_steps(df: DataFrame, steps: int, profile: DataFrame, on: list[str], phase: str, cycle: int, distance: str, rate: str, per: float) -> DataFrame:
    """A row for each of the next steps: column step, the columns of the profile at the phase that many places on, and
    <distance>_proj, the distance less what it loses by then at `rate` for every `per` steps.

    profile: (on, phase, further columns), one row for each phase from 0 to cycle - 1; phases without one give NULL. Rows are
    copied before the join, so the profile is read once for all steps.
    """
    told = df.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    told = told.withColumn("_then", F.pmod(F.col(phase) + F.col("step"), F.lit(cycle)).cast("long"))
    out = told.join(profile.withColumnRenamed(phase, "_then"), [*on, "_then"], "left").drop("_then")
    return out.withColumn(f"{distance}_proj", F.col(distance) - F.col(rate) * F.col("step") / per)


def select_origins(df: DataFrame, keys: list[str], link: str, order: str, flag: str, history: int, horizon: int, least: int, cap: float, spacing: int) -> DataFrame:
    """(keys, ongoing, order) of the places to forecast from, `spacing` or more apart within each condition.

    A place counts if anything is flagged in the next `horizon` rows of a link. It is ongoing if some link has `least` flags or
    more in the `history` rows before it and itself, else an onset. An ongoing one is passed over, without holding others off,
    if what is flagged now, held still, overlaps the horizon by more than `cap`: there is nothing to forecast. df is a dense
    panel; places whose history or horizon reaches beyond its ends are none. A missing flag is none.
    """
    now = F.coalesce(F.col(flag), F.lit(False))
    w = Window.partitionBy(*keys, link).orderBy(order)
    ahead = w.rowsBetween(1, horizon)
    cells = df.select(*keys, link, order, now.alias("_now")).withColumns(
        {
            "_held": F.count_if("_now").over(w.rowsBetween(-history, 0)),
            "_later": F.count_if("_now").over(ahead),
            "_rows": F.count(F.lit(1)).over(w.rowsBetween(-history, horizon)),
        }
    )
    still = F.col("_now").cast("int")
    places = cells.groupBy(*keys, order).agg(
        (F.max("_held") >= least).alias("ongoing"),
        F.sum(still * F.col("_later")).alias("_inter"),
        F.sum(F.col("_later") + still * (horizon - F.col("_later"))).alias("_union"),
        F.sum("_later").alias("_any"),
        F.min("_rows").alias("_rows"),
    )
    held = F.col("ongoing") & (F.col("_inter") > cap * F.col("_union"))
    open_ = places.filter((F.col("_rows") == history + horizon + 1) & (F.col("_any") > 0) & ~held)
    return greedy_spaced(open_, [*keys, "ongoing"], order, None, spacing, None).select(*keys, "ongoing", order)


def transitions(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change to the next slot where that is there."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_o", F.lead(order).over(w)).withColumn("step_change", F.lead(value).over(w) - F.col(value))
    return out.filter(F.col("_o") == F.col(order) + 1).select(*keys, order, "step_change")


def capped_sample(df: DataFrame, groups: list[str], key: str, cap: int, seed: str = "") -> DataFrame:
    """At most `cap` rows of a group, those whose md5 of key and seed come first."""
    w = Window.partitionBy(*groups).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def hash_sample(df: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """A fraction of the rows by the first 28 bits of md5."""
    part = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 7), 16, 10).cast("long")
    return df.filter(part < int(share * (1 << 28)))


def top_by_priority(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """Rows with their place in the order, and whether they are among the first k."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).withColumn("picked", F.col("place") <= k)
