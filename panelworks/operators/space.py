"""Neighbours along an ordered axis: offsets, distance bands, mass, profile shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.blend import with_places


def offsets(df: DataFrame, keys: list[str], pos: str, value: str, by: list[int], hold: bool = False) -> DataFrame:
    """Value at pos + o for each o, as o_<o> (m for minus). Beyond the ends 0, or with `hold` the end's value."""
    w = Window.partitionBy(*keys).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for o in by:
        edge = (F.last(value).over(whole) if o > 0 else F.first(value).over(whole)) if hold else F.lit(0.0)
        there = F.lead(F.struct(value), o).over(w) if o > 0 else F.lag(F.struct(value), -o).over(w)
        cols[f"o_{'m' if o < 0 else ''}{abs(o)}"] = F.when(there.isNotNull(), there[value]).otherwise(edge)
    return df.withColumns(cols)


def neighbour_cells(df: DataFrame, keys: list[str], slot: str, pos: str, value: str, deltas: list[tuple[int, int]]) -> DataFrame:
    """Value at (slot + dt, pos + dl) for each delta, NULL outside the grid, as c_<dt>_<dl>.

    One exploded copy and one sum by cell in place of a join for each delta.
    """
    names = {d: f"c_{d[0]}_{d[1]}".replace("-", "m") for d in deltas}
    moved = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), slot, pos, F.explode(F.array(*[F.struct(F.lit(dt).alias("dt"), F.lit(dl).alias("dl")) for dt, dl in deltas])).alias("_d")
    )
    moved = moved.select(*keys, (F.col(slot) - F.col("_d.dt")).alias(slot), (F.col(pos) - F.col("_d.dl")).alias(pos), "_d", "_v")
    cells = moved.groupBy(*keys, slot, pos).agg(*[F.max(F.when((F.col("_d.dt") == dt) & (F.col("_d.dl") == dl), F.col("_v"))).alias(n) for (dt, dl), n in names.items()])
    return df.join(cells, [*keys, slot, pos], "left")


def nearest_observed(df: DataFrame, keys: list[str], pos: str, value: str, reach: int) -> DataFrame:
    """Nearest observed value within `reach` rows on each side."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumns({"near_down": F.first(value, ignorenulls=True).over(w.rowsBetween(1, reach)), "near_up": F.last(value, ignorenulls=True).over(w.rowsBetween(-reach, -1))})


def band_minimum(df: DataFrame, keys: list[str], metres: str, value: str, bands: list[tuple[int, int]]) -> DataFrame:
    """Least value at distances in (lo, hi] metres on each side, as dn_<hi> and up_<hi>. metres is a whole number."""
    w = Window.partitionBy(*keys).orderBy(metres)
    cols = {}
    for lo, hi in bands:
        cols[f"dn_{hi}"] = F.min(value).over(w.rangeBetween(lo + 1, hi))
        cols[f"up_{hi}"] = F.min(value).over(w.rangeBetween(-hi, -lo - 1))
    return df.withColumns(cols)


def band_mass(df: DataFrame, keys: list[str], metres: str, value: str, reaches: list[int], least: str | None = None) -> DataFrame:
    """Sum of value within each reach on each side, the row itself left out; `least`: minimum of that column from here to the largest reach."""
    w = Window.partitionBy(*keys).orderBy(metres)
    cols = {}
    for r in reaches:
        cols[f"mass_dn_{r}"] = F.coalesce(F.sum(value).over(w.rangeBetween(1, r)), F.lit(0.0))
        cols[f"mass_up_{r}"] = F.coalesce(F.sum(value).over(w.rangeBetween(-r, -1)), F.lit(0.0))
    if least:
        cols[f"least_{least}"] = F.min(least).over(w.rangeBetween(0, max(reaches)))
    return df.withColumns(cols)


def profile(df: DataFrame, keys: list[str], pos: str, metres: str, p: str) -> DataFrame:
    """Maximum, sum, relative value, rank, offset and distance to the first maximum, head and tail proxies."""
    k = Window.partitionBy(*keys)
    w = k.orderBy(pos)
    best = F.max_by(F.struct(pos, metres), F.struct(F.col(p).alias("p"), (-F.col(pos)).alias("o"))).over(k)
    out = df.withColumn("_b", best)
    return out.select(
        *df.columns,
        F.max(p).over(k).alias("p_max"),
        F.sum(p).over(k).alias("p_sum"),
        (F.col(p) / F.greatest(F.max(p).over(k), F.lit(1e-6))).alias("p_rel"),
        (F.row_number().over(k.orderBy(F.col(p).desc(), pos)) - 1).cast("long").alias("p_rank"),
        (F.col(pos) - F.col(f"_b.{pos}")).alias("off_best"),
        (F.col(metres) - F.col(f"_b.{metres}")).alias("m_best"),
        (F.col(p) * (1 - F.coalesce(F.lead(p).over(w), F.lit(0.0)))).alias("head"),
        (F.col(p) * (1 - F.coalesce(F.lag(p).over(w), F.lit(0.0)))).alias("tail"),
    )


def axis_context(df: DataFrame, keys: list[str], slot: str, value: str, flag: str) -> DataFrame:
    """Share flagged and least value of the whole axis at a slot, and the change of the share to 1 and 4 slots before."""
    per = df.groupBy(*keys, slot).agg(F.avg(F.col(flag).cast("double")).alias("share"), F.min(value).alias("least"))
    w = Window.partitionBy(*keys).orderBy(slot)
    return per.withColumns({"trend_1": F.col("share") - F.lag("share", 1).over(w), "trend_4": F.col("share") - F.lag("share", 4).over(w)})


def direction_vote(axis: DataFrame, edges: DataFrame, pos: str, link: str) -> DataFrame:
    """Of the consecutive pairs of links, how many are edges forward and backward; links at one position follow by name.

    A link's place is worked out by ranges of positions, and pairs are a join of each place with the next, so no task holds
    the axis.
    """
    placed = with_places(axis.select(F.col(link).alias("a"), F.col(pos).alias("_pos"), F.lit(0).alias("_axis")), ["_axis"], "_pos")
    placed = placed.select("a", (F.col("_below") + F.row_number().over(Window.partitionBy("_pos").orderBy("a"))).alias("_place"))
    pairs = placed.join(placed.select(F.col("a").alias("b"), (F.col("_place") - 1).alias("_place")), "_place").select("a", "b")
    ahead = pairs.join(edges.select(F.col("from_link").alias("a"), F.col("to_link").alias("b")).distinct(), ["a", "b"], "left_semi")
    back = pairs.join(edges.select(F.col("from_link").alias("b"), F.col("to_link").alias("a")).distinct(), ["a", "b"], "left_semi")
    counts = ahead.select(F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(back.select(F.lit(0).alias("f"), F.lit(1).alias("r")))
    return counts.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("forward"), F.coalesce(F.sum("r"), F.lit(0)).alias("backward"))


def step_increments(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Change of a value to the step before and to the first step."""
    w = Window.partitionBy(*keys).orderBy(step)
    return df.withColumns({"d_step": F.col(value) - F.lag(value).over(w), "d_origin": F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
