"""Contracts as check rows, alignment to templates, differences of sheets, keyed set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exact names in order."""
    ok = df.columns == expected
    return df.sparkSession.range(1).select(F.lit("columns").alias("name"), F.lit(ok).alias("ok"), F.lit("" if ok else f"{df.columns}").alias("info"))


def check_records(df: DataFrame, record: str, expected: list[str]) -> DataFrame:
    """The column lists that JSON records have, in their order, how many records have each, and whether it is the expected
    one. Records that are no objects have no columns. Rows are counted in their tasks first."""
    columns = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    counts = df.groupBy(columns.alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.array_join("_c", ",").alias("columns"), "n", (F.col("_c") == F.array(*[F.lit(c) for c in expected])).alias("ok"))


def check_keys(df: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate, missing and extra keys, as check rows (name, n, ok)."""
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    both = own.join(required.select(*keys).distinct().withColumn("_r", F.lit(True)), keys, "full")
    counts = both.agg(F.count_if(F.col("_n") > 1).alias("duplicate"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_r").isNull()).alias("extra"))
    return counts.select(F.expr("stack(3, 'duplicate', duplicate, 'missing', missing, 'extra', extra) as (name, n)")).withColumn("ok", F.col("n") == 0)


def check_values(df: DataFrame, group: list[str], checks: dict[str, Column]) -> DataFrame:
    """Each check is a boolean row expression; rows against it by group, all checks in one aggregation."""
    names = list(checks)
    counts = df.groupBy(*group).agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.unpivot(group, names, "name", "n_bad").withColumn("ok", F.col("n_bad") == 0)


def check_same_rows(a: DataFrame, b: DataFrame, untouched: Column) -> DataFrame:
    """Rows of the untouched part that only one side has, repeated rows counted."""
    x, y = a.filter(untouched), b.filter(untouched)
    one = x.exceptAll(y).agg(F.count(F.lit(1)).alias("only_first"))
    return one.crossJoin(y.exceptAll(x).agg(F.count(F.lit(1)).alias("only_second")))  # one row each


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def attach(facts: DataFrame, dimension: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join to a dimension of which the first duplicate of a key wins. Catalyst broadcasts it if its size allows."""
    return facts.join(first_per_key(dimension, keys, order), keys, "left")


def align(template: DataFrame, predictions: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """The template's keys with the predicted value, else the default, and whether it was missing."""
    out = template.select(*keys).join(predictions.select(*keys, value), keys, "left")
    return out.withColumn("missing", F.col(value).isNull()).withColumn(value, F.coalesce(value, F.lit(default)))


def tall_sheet(template: DataFrame, frames: dict[str, tuple[DataFrame, list[str], str]], task: str, default: float = 0.0) -> DataFrame:
    """A row for each template row, with a column for each task's value: its own frame's in rows of that task, the default elsewhere.

    frames: task -> (predictions, keys, value); the template holds the keys of all tasks. `missing` marks rows of a known task
    without a prediction.
    """
    out = template.withColumn("missing", F.lit(False))
    for name, (predictions, keys, value) in frames.items():
        own = predictions.select(*keys, F.col(value).alias("_v"), F.lit(name).alias(task))
        found = F.when(F.col(task) == name, F.col("_v"))
        joined = out.join(own, [*keys, task], "left")
        out = joined.withColumn("missing", F.col("missing") | ((F.col(task) == name) & F.col("_v").isNull())).withColumn(value, F.coalesce(found, F.lit(default))).drop("_v")
    return out


def fallback(units: DataFrame, children: DataFrame, key: str, value: str, prior: float) -> DataFrame:
    """Mean of a unit's child rows with their number, the prior and -1 for units without any."""
    own = children.groupBy(key).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return units.select(key).join(own, key, "left").withColumns({value: F.coalesce(value, F.lit(prior)), "n": F.coalesce("n", F.lit(-1).cast("long"))})


def overwrite(base: DataFrame, new: DataFrame, keys: list[str], flag: str, where: Column, unit: list[str]) -> tuple[DataFrame, DataFrame]:
    """Base with new flags in the rows of `where`, and an audit by unit: cells added and removed, and the agreement of both sets."""
    both = base.join(new.select(*keys, F.col(flag).alias("_new")), keys, "left")
    out = both.withColumn("_out", F.when(where, F.coalesce("_new", flag)).otherwise(F.col(flag)))
    union = F.count_if(F.col(flag) | F.col("_out"))
    audit = out.groupBy(*unit).agg(
        F.count_if(~F.col(flag) & F.col("_out")).alias("added"), F.count_if(F.col(flag) & ~F.col("_out")).alias("removed"),
        F.when(union == 0, 1.0).otherwise(F.count_if(F.col(flag) & F.col("_out")) / union).alias("agreement"),
    )
    return out.withColumn(flag, F.col("_out")).drop("_new", "_out"), audit


def sheet_difference(a: DataFrame, b: DataFrame, keys: list[str], group: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows, changed rows, rows of one side only, and mean absolute difference by group."""
    x, y = a.select(*keys, *group, F.col(value).alias("_a")), b.select(*keys, *group, F.col(value).alias("_b"))
    both = x.join(y, [*keys, *group], "full")
    d = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > tolerance).alias("changed"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided"), F.avg(d).alias("mean_difference"))


def equal_shares(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], group: str, tolerance: float) -> DataFrame:
    """Share of equal cells of each column (NULL equals NULL), and the least share over groups."""
    x = a.unpivot([*keys, group], columns, "column", "x")
    y = b.unpivot([*keys, group], columns, "column", "y").drop(group)
    both = x.join(y, [*keys, "column"])
    same = F.coalesce((F.abs(F.col("x") - F.col("y")) <= tolerance), F.col("x").isNull() & F.col("y").isNull())
    by = both.groupBy("column", group).agg(F.count_if(same).alias("s"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("column").agg((F.sum("s") / F.sum("n")).alias("share"), F.min(F.col("s") / F.col("n")).alias("worst"))


def rescale(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Value clipped to the group's percentiles and scaled to [0, 1]; by minimum and maximum if they are equal, 0 for a constant group."""
    s = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = s.select(*keys, F.when(F.col("q")[1] > F.col("q")[0], F.col("q")[0]).otherwise(F.col("lo")).alias("lo"), F.when(F.col("q")[1] > F.col("q")[0], F.col("q")[1]).otherwise(F.col("hi")).alias("hi"))
    out = df.join(s, keys)
    scaled = F.when(F.col("hi") > F.col("lo"), (F.least(F.greatest(value, "lo"), "hi") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return out.withColumn("scaled", scaled).drop("lo", "hi")


def resolve_attribute(df: DataFrame, key: str, tag: str, value: str, order: str, zone: float) -> DataFrame:
    """The first tag of a key by order, else the sign of its median value outside a dead zone; and whether both exist and differ."""
    s = df.groupBy(key).agg(F.min_by(tag, F.when(F.col(tag).isNotNull(), F.col(order))).alias("told"), F.median(value).alias("m"))
    guess = F.when(F.col("m") > zone, "R").when(F.col("m") < -zone, "L")
    return s.select(key, F.coalesce(F.when(F.col("told").isNotNull(), F.col("told")), guess).alias("side"), F.coalesce((F.col("told") != guess), F.lit(False)).alias("disagrees"))


def pin(df: DataFrame, anchors: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of pinned keys replaced; anchors has one row a key."""
    return df.join(anchors.select(*keys, F.col(value).alias("_a")), keys, "left").withColumn(value, F.coalesce("_a", value)).drop("_a")


def unique_sets(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Each different set of items, with the number of keys that hold it and its size."""
    sets = df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("cells"), F.count_distinct(item).alias("size"))
    return sets.groupBy("cells", "size").agg(F.count(F.lit(1)).alias("n"))
