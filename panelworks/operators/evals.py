"""Evaluation tables, slices and the last row operators: recurrence, growth, diagnosis, variant grids, picks and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluation_table(df: DataFrame, variant: str, group: list[str], value: str, reference: str) -> DataFrame:
    """Mean of each variant and group, the change against the reference variant, and in how many groups it is better."""
    own = df.groupBy(variant, *group).agg(F.avg(value).alias("mean"))
    base = F.max(F.when(F.col(variant) == reference, F.col("mean"))).over(Window.partitionBy(*group))
    delta = own.withColumn("delta", F.col("mean") - base)
    v = Window.partitionBy(variant)
    return delta.withColumns({"mean_delta": F.avg("delta").over(v), "n_up": F.count_if(F.round("delta", 9) > 0).over(v)})


def recurrence(cells: DataFrame, keys: list[str], flag: str, rate: str) -> DataFrame:
    """Mean long-run rate over the cells that are flagged now, 0 without any."""
    return cells.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(flag), F.col(rate))), F.lit(0.0)).alias("recurrence"))


def slices_below(df: DataFrame, keys: list[str], by: str, value: str, cuts: list[float]) -> DataFrame:
    """For each cut the rows below it and their mean value; all cuts in one aggregation."""
    aggs = [x for c in cuts for x in (F.count_if(F.col(by) < c).alias(f"n_{c}"), F.avg(F.when(F.col(by) < c, F.col(value))).alias(f"m_{c}"))]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"`n_{c}`").alias("n"), F.col(f"`m_{c}`").alias("mean")) for c in cuts])).alias("x")
    return wide.select(*keys, rows).select(*keys, "x.*")


def gated_blend(df: DataFrame, a: str, b: str, gate: Column, share: float) -> DataFrame:
    """(1 - share) a + share b where the gate holds, a elsewhere."""
    return df.withColumn("blend", F.when(gate, (1 - share) * F.col(a) + share * F.col(b)).otherwise(F.col(a)))


def growth(df: DataFrame, window: list[str], slice_: str, step: str, predicted: str, true: str) -> DataFrame:
    """Mean predicted, true and hit cells of a window, by slice and step and over each and all of them."""
    p, t = F.col(predicted), F.col(true)
    own = df.groupBy(*window, slice_, step).agg(F.count_if(p).alias("p"), F.count_if(t).alias("t"), F.count_if(p & t).alias("h"))
    out = own.cube(slice_, step).agg(F.avg("p").alias("predicted"), F.avg("t").alias("true"), F.avg("h").alias("hit"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return out


def diagnose(cells: DataFrame, keys: list[str], pos: str, predicted: str, true: str) -> DataFrame:
    """The pair of predicted and true block with the largest overlap, head and tail offsets, wrong and missed cells in and outside it."""
    from panelworks.operators.runs import overlap_match, runs

    p, t = runs(cells, keys, pos, predicted), runs(cells, keys, pos, true)
    m = overlap_match(p.select(*keys, "run_start", "run_end"), t.select(*keys, "run_start", "run_end"), keys).filter("overlap > 0")
    best = m.groupBy(*keys).agg(F.min(F.struct((-F.col("overlap")).alias("o"), "run_start", "before_start", "run_end", "before_end")).alias("b"))
    best = best.select(*keys, *[F.col(f"b.{a}").alias(b) for a, b in (("run_start", "p_tail"), ("run_end", "p_head"), ("before_start", "t_tail"), ("before_end", "t_head"))])
    x = cells.join(best, keys, "left")
    inside = F.col(pos).between(F.least("p_tail", "t_tail"), F.greatest("p_head", "t_head"))
    wrong, missed = F.col(predicted) & ~F.col(true), F.col(true) & ~F.col(predicted)
    return x.groupBy(*keys).agg(
        F.first("p_tail").isNotNull().alias("site_right"), (F.first("p_head") - F.first("t_head")).alias("head_off"), (F.first("p_tail") - F.first("t_tail")).alias("tail_off"),
        F.count_if(wrong & inside).alias("wrong_in"), F.count_if(missed & inside).alias("missed_in"), F.count_if(wrong & ~F.coalesce(inside, F.lit(False))).alias("wrong_out"), F.count_if(missed & ~F.coalesce(inside, F.lit(False))).alias("missed_out"),
    )


def blend_available(df: DataFrame, keys: list[str], base: str, arm: str, eligible: str, share: float) -> DataFrame:
    """Rank of base, mixed with the arm's rank among eligible rows; absent rows keep the base alone."""
    from panelworks.operators.blend import rank_share

    out = rank_share(rank_share(df, keys, base, "_b"), [*keys, eligible], arm, "_a")
    return out.withColumn("blend", F.when(F.col(eligible), (1 - share) * F.col("_b") + share * F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def applicability(df: DataFrame, keys: list[str], value: str, eligible: str) -> DataFrame:
    """Absent rows that have a value, and acquired rows without one."""
    return df.groupBy(*keys).agg(F.count_if(~F.col(eligible) & F.col(value).isNotNull()).alias("absent_filled"), F.count_if(F.col(eligible) & F.col(value).isNull()).alias("acquired_missing"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Largest difference of two tables on equal keys, and whether it is within the tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    d = F.max(F.abs(F.col("_a") - F.col("_b")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(d, 9).alias("largest"), (d <= tolerance).alias("ok"))


def even_picks(n: Column, k: int) -> Column:
    """K whole numbers spread evenly over 0 .. n - 1, rounded half to even; all of them if there are no more than k."""
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(k - 1, 1))).cast("long")))


def window_starts(n: Column, size: int, overlap: bool) -> Column:
    """Starts of windows of `size`: each place if they overlap and one fits, else one after another, one at least."""
    tiled = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(n / size), F.lit(1)) - 1), lambda g: g * size)
    return F.when(n >= size, F.sequence(F.lit(0).cast("long"), n.cast("long") - size)).otherwise(tiled) if overlap else tiled


def quotas(df: DataFrame, key: str, unit: str, capacity: str, share: str, target: int) -> DataFrame:
    """The target dealt to a key's units by largest remainder, capped by capacity; what is left goes one at a time to the unit
    with the largest claim, which grows by its share among units with room. A fold over the key's few units."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(capacity).cast("long").alias("c"), F.col(share).cast("double").alias("s")))).alias("x"))
    whole = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["s"])
    told = lists.withColumn("t", whole).withColumn("ideal", F.transform("x", lambda x: target * x["s"] / F.col("t")))
    order = F.array_sort(F.transform("ideal", lambda v, i: F.struct((-F.round(v - F.floor(v), 9)).alias("r"), i.alias("i"))))
    told = told.withColumn("up", F.transform(F.slice(order, F.lit(1), (target - F.aggregate("ideal", F.lit(0).cast("long"), lambda a, v: a + F.floor(v))).cast("int")), lambda o: o["i"]))
    first = F.transform("ideal", lambda v, i: F.floor(v) + F.when(F.array_contains("up", i), 1).otherwise(0))
    told = told.withColumn("q", F.zip_with(first, "x", lambda q, x: F.least(q, x["c"]))).withColumn("left", F.least(F.lit(target).cast("long"), F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["c"])) - F.aggregate("q", F.lit(0).cast("long"), lambda a, q: a + q))
    start = F.transform(F.arrays_zip("x", "q"), lambda z: F.struct(z["x"]["u"].alias("u"), z["x"]["c"].alias("c"), z["x"]["s"].alias("s"), z["q"].alias("q"), F.lit(0.0).alias("d")))

    def step(acc, _):
        room = F.aggregate(acc, F.lit(0.0), lambda a, z: a + F.when(z["q"] < z["c"], z["s"]).otherwise(0.0))
        grown = F.transform(acc, lambda z: F.struct(z["u"].alias("u"), z["c"].alias("c"), z["s"].alias("s"), z["q"].alias("q"), (z["d"] + F.when(z["q"] < z["c"], z["s"] / room).otherwise(0.0)).alias("d")))
        pick = F.array_min(F.transform(F.filter(grown, lambda z: z["q"] < z["c"]), lambda z: F.struct((-F.round(z["d"], 9)).alias("d"), z["u"].alias("u"))))["u"]
        return F.transform(grown, lambda z: F.struct(z["u"].alias("u"), z["c"].alias("c"), z["s"].alias("s"), (z["q"] + F.when(z["u"] == pick, 1).otherwise(0)).alias("q"), (z["d"] - F.when(z["u"] == pick, 1.0).otherwise(0.0)).alias("d")))

    turns = F.when(F.col("left") > 0, F.sequence(F.lit(1).cast("long"), F.col("left"))).otherwise(F.array().cast("array<bigint>"))
    done = told.select(key, F.explode(F.aggregate(turns, start, step)).alias("z"))
    return done.select(key, F.col("z.u").alias(unit), F.col("z.c").alias(capacity), F.col("z.q").alias("quota"))


def order_with_fallback(df: DataFrame, group: str, position: str, number: str, name: Column) -> DataFrame:
    """Rows ordered by position if a group's are complete and different, else by number likewise, else by name; and the median step of position."""
    g = Window.partitionBy(group)
    usable = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.count_distinct(c) == F.count(F.lit(1)))
    how = df.groupBy(group).agg(F.when(usable(position), "position").when(usable(number), "number").otherwise("name").alias("how"))
    told = df.join(how, group).withColumn("_k", name)
    key = F.when(F.col("how") == "position", F.col(position)).when(F.col("how") == "number", F.col(number).cast("double"))
    w = g.orderBy(key, "_k")
    out = told.withColumn("place", F.row_number().over(w).cast("long")).withColumn("_d", F.when(F.col("how") == "position", F.col(position) - F.lag(position).over(w)))
    return out.withColumn("spacing", F.median("_d").over(g)).drop("_k", "_d")


def classify_names(name: Column, families: dict[str, str], options: Column) -> dict[str, Column]:
    """P20: separators become spaces, then the first family whose pattern matches; and whether an option list ('A|B') holds FS."""
    text = F.regexp_replace(F.lower(name), r"[_\-./#]+", " ")
    out = F.lit("other")
    for label, pattern in list(families.items())[::-1]:
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return {"family": out, "option": F.exists(F.split(options, r"\|"), lambda o: o == "FS")}


def hybrid_truth(df: DataFrame, keys: list[str], slot: str, pos: str, observed: str, guess: str) -> DataFrame:
    """Missing labels take the guess only within one slot and two positions of an observed positive, else false."""
    moved = df.filter(F.coalesce(F.col(observed), F.lit(False))).select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in range(-2, 3)])).alias("d"), slot, pos)
    near = moved.select(*keys, (F.col(slot) + F.col("d.a")).alias(slot), (F.col(pos) + F.col("d.b")).alias(pos)).distinct().withColumn("_near", F.lit(True))
    out = df.join(near, [*keys, slot, pos], "left")
    return out.withColumn("label", F.coalesce(observed, F.col(guess) & F.coalesce("_near", F.lit(False)))).drop("_near")


def decompose_totals(totals: DataFrame, full: str, weights: DataFrame) -> DataFrame:
    """What each task adds to a total score: (full total - total without the task) / the task's weight.

    totals (variant, total) has a row for each ablated task and one for the full sheet; weights (variant, w) is small.
    """
    whole = F.max(F.when(F.col("variant") == full, F.col("total"))).over(Window.partitionBy())  # a row for each variant
    return totals.withColumn("_f", whole).join(weights, "variant").select("variant", ((F.col("_f") - F.col("total")) / F.col("w")).alias("task_score"))


def without_groups(df: DataFrame, groups: dict[str, list[str]], dropped: list[str]) -> DataFrame:
    """Df without the columns of the named feature groups."""
    return df.drop(*[c for g in dropped for c in groups[g]])
