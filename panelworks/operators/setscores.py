"""Prediction rows decoded in several ways and held against several truths, in one pass over the windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _overlap(p: Column, run, whole) -> Column:
    """Expected overlap of the set that ends at each row."""
    so_far = F.sum(p).over(run)
    return F.round(so_far / (F.col("_rn") + F.sum(p).over(whole) - so_far), 9)


def _size(rule: tuple, p: str, run, whole) -> Column:
    """How many of a window's rows by falling p a rule takes."""
    kind, given = rule[0], rule[1:]
    if kind == "cut":
        return F.greatest(F.count_if(F.col(p) >= given[0]).over(whole), F.lit(1))
    if kind == "top":
        return F.least(F.count(F.lit(1)).over(whole), F.lit(given[0]))
    if kind == "expected":
        value = F.struct(_overlap(F.pow(F.col(p), F.lit(float(given[0]))), run, whole).alias("v"), (-F.col("_rn")).alias("r"))
        return value if given[1] is None else F.when(F.col("_rn") <= given[1], value)
    raise ValueError(f"no such decoder: {kind}")


def score_rows(rows: DataFrame, truths: DataFrame, keys: list[str], cells: list[str], p: str, decoders: dict[str, tuple], names: list[str]) -> DataFrame:
    """Overlap of each window's decoded set with each truth: keys, decoder, truth, iou, size, n_true, surrogate.

    rows (keys, cells, p), one for a cell; truths (keys, cells, truth), one for each positive cell of a truth. decoders name
    rules: ("expected", power, cap) is the set of largest expected overlap of p ** power, the smallest on a tie; ("cut", least)
    takes p from `least` on, and the first row where there is none; ("top", k) takes k rows. All are the first rows by falling
    p, then by cells, so a window is sorted once for all of them, and one aggregation counts every hit. surrogate is the
    expected overlap of the set under p itself. True cells that have no row count in the union; a window without rows decodes
    to the empty set, two empty sets overlap by 1, and rows without p are left out.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(p).desc(), *cells)
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    ranked = rows.select(*keys, *cells, p).filter(F.col(p).isNotNull()).withColumn("_rn", F.row_number().over(order))
    ranked = ranked.withColumn("_e", _overlap(F.col(p), run, whole)).withColumns({f"_m{k}": _size(rule, p, run, whole) for k, rule in enumerate(decoders.values())})
    best = {f"_m{k}": -F.max(f"_m{k}").over(whole)["r"] for k, rule in enumerate(decoders.values()) if rule[0] == "expected"}
    ranked = ranked.withColumns(best)
    held = truths.filter(F.col("truth").isin(names)).groupBy(*keys, *cells).agg(F.collect_set("truth").alias("_t"))
    both = ranked.join(held, [*keys, *cells], "full")
    is_true = [F.coalesce(F.array_contains("_t", t), F.lit(False)) for t in names]
    taken = [F.coalesce(F.col("_rn") <= F.col(f"_m{k}"), F.lit(False)) for k in range(len(decoders))]
    sums = [F.count_if(t).alias(f"_n{j}") for j, t in enumerate(is_true)]
    for k, own in enumerate(taken):
        sums += [F.count_if(own).alias(f"_s{k}"), F.max(F.when(F.col("_rn") == F.col(f"_m{k}"), F.col("_e"))).alias(f"_u{k}")]
        sums += [F.count_if(own & t).alias(f"_h{k}_{j}") for j, t in enumerate(is_true)]
    told = F.array(
        *[
            F.struct(
                F.lit(d).alias("decoder"), F.lit(t).alias("truth"), F.col(f"_s{k}").alias("size"), F.col(f"_n{j}").alias("n_true"), F.col(f"_h{k}_{j}").alias("hits"), F.col(f"_u{k}").alias("surrogate")
            )
            for k, d in enumerate(decoders)
            for j, t in enumerate(names)
        ]
    )
    out = both.groupBy(*keys).agg(*sums).select(*keys, F.explode(told).alias("x")).select(*keys, "x.*")
    union = F.col("size") + F.col("n_true") - F.col("hits")
    return out.withColumn("iou", F.when(union == 0, 1.0).otherwise(F.col("hits") / union)).drop("hits")
