"""Fits over whole tables: two-way effects with a slope, and rank correlations of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.blend import places
from panelworks.sources.files import written


def two_way_fit(df: DataFrame, keys: list[str], a: str, b: str, x: str, y: str, tolerance: float = 1e-10, rounds: int = 100) -> DataFrame:
    """Least squares of y = effect of a + effect of b + slope * x for each key: slope, residual deviation (over n), n.

    The effects are taken out of x and y by turns, the means of a and then those of b, until no cell moves by over `tolerance`
    times the largest value; then the slope is that of what is left. Rows are summed up by (keys, a, b) first. After every two
    turns a key's cells are moved on along their last step, as far as the change of the steps says (three points on a line),
    which saves most turns. Rows with a NULL in any of the columns are left out. The slope is NULL where x is itself a sum of
    effects. ArithmeticError if cells still move after `rounds` times two turns.
    """
    known = df.select(*keys, a, b, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    n = F.count(F.lit(1))
    within = {"_sxx": n * F.var_pop("_x"), "_sxy": n * F.covar_pop("_x", "_y"), "_syy": n * F.var_pop("_y")}
    cells = known.groupBy(*keys, a, b).agg(n.alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), *[v.alias(k) for k, v in within.items()])
    cells = written(cells.withColumn("_x0", F.col("_mx")), "cells")
    values = ["_mx", "_my"]
    top = cells.agg(*[F.max(F.abs(c)).alias(c) for c in values]).first()
    for _ in range(rounds):
        for turn in range(2):
            cells = cells.withColumns({f"{c}{turn}": F.col(c) for c in values})
            for level in (a, b):
                w = Window.partitionBy(*keys, level)
                cells = cells.withColumns({c: F.col(c) - F.sum(F.col("_n") * F.col(c)).over(w) / F.sum("_n").over(w) for c in values})
        cells = written(cells, "turns")
        step = {c: F.col(c) - F.col(f"{c}1") for c in values}
        bend = {c: step[c] - (F.col(f"{c}1") - F.col(f"{c}0")) for c in values}
        moved = F.max(F.greatest(*[F.abs(step[c]) / max(top[c] or 0.0, 1e-300) for c in values]))
        if (cells.agg(moved).first()[0] or 0.0) <= tolerance:
            break
        far = [F.coalesce(F.try_divide(F.sum(F.col("_n") * step[c] * bend[c]), F.sum(F.col("_n") * bend[c] * bend[c])), F.lit(0.0)).alias(f"_far{c}") for c in values]
        ahead = cells.join(cells.groupBy(*keys).agg(*far), keys).withColumns({c: F.col(c) - F.col(f"_far{c}") * step[c] for c in values})
        cells = ahead.drop(*[f"_far{c}" for c in values], *[f"{c}{turn}" for c in values for turn in range(2)])
    else:
        raise ArithmeticError(f"cells still move after {rounds} rounds")
    product = lambda p, q, own: F.sum(F.col("_n") * F.col(p) * F.col(q) + F.col(own))
    spread = F.sum("_sxx") + F.sum("_n") * F.var_pop("_x0") + F.max(F.abs("_x0"))
    sums = cells.groupBy(*keys).agg(product("_mx", "_mx", "_sxx").alias("_xx"), product("_mx", "_my", "_sxy").alias("_xy"), product("_my", "_my", "_syy").alias("_yy"), F.sum("_n").alias("n"), spread.alias("_all"))
    slope = F.when(F.col("_xx") > 1e-12 * F.col("_all"), F.col("_xy") / F.col("_xx"))
    rest = F.col("_yy") - F.coalesce(F.col("slope") * F.col("_xy"), F.lit(0.0))
    return sums.withColumn("slope", slope).select(*keys, "slope", F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("residual_sd"), "n")


#: Values of a column up to which their ranks are broadcast.
FEW_VALUES = 100_000


def rank_correlations(df: DataFrame, row: list[str], columns: list[str]) -> DataFrame:
    """Correlation of the average ranks of every two columns: one, other, n, rho. row names a row.

    Rows with a NULL in any of the columns are left out. The different values of all columns are ranked in one pass as a long
    table, by ranges; then each row looks its ranks up, column by column, and all pairs are summed in one aggregation. Columns
    of up to FEW_VALUES values are looked up in a broadcast table.
    """
    known = df.select(*row, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    long = known.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("c")).select("c.*")
    ranks = written(places(long, ["column"], "value").select("column", F.col("_v").alias("_value"), ((F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_n")).alias("_rank")), "ranks")
    few = {r["column"] for r in ranks.groupBy("column").count().filter(F.col("count") <= FEW_VALUES).collect()}
    wide = known
    for k, c in enumerate(columns):
        own = ranks.filter(F.col("column") == c).select("_value", F.col("_rank").alias(f"r{k}"))
        wide = wide.join(F.broadcast(own) if c in few else own, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    pairs = list(combinations(range(len(columns)), 2))
    found = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    told = F.array(*[F.struct(F.lit(columns[i]).alias("one"), F.lit(columns[j]).alias("other"), F.col(f"c{i}_{j}").alias("rho")) for i, j in pairs])
    return found.select(F.explode(told).alias("t"), "n").select("t.one", "t.other", "n", "t.rho")
