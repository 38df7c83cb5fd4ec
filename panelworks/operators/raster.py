"""Run arithmetic on masks: polygons to runs, and runs joined, cut and taken away from one another, half open [x0, x1).

Runs are joined on equal keys (an image's row and what else identifies a layer) and filtered by overlap, so no mask is ever
spelt out as cells; only contrast and votes, which need a value or a count for each cell, do so for the few cells they ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.sources.files import written


#: Rows of a polygon whose crossings are sorted together.
BAND = 1024


def polygon_runs(polygons: DataFrame, keys: list[str], points: str) -> DataFrame:
    """(keys, row, x0, x1) of the cells whose centre is inside a closed polygon, by the even-odd rule.

    points: array of structs (x, y), the last joined to the first. Every edge crosses the centre lines of some rows, its lower
    end included; a row's crossings, sorted, are taken in pairs. A polygon's edges are cut into bands of BAND rows, and the
    crossings of a band are sorted within one row of the table, so no crossing is shuffled. Null polygons and those of under
    three points have no cells; the rings of one key are one polygon, so a ring within another is a hole.
    """
    n = F.size(points)
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(points, k).alias("a"), F.get(points, (k + 1) % n).alias("b")))
    edges = polygons.filter(n >= 3).select(*keys, F.explode(ends).alias("e")).select(
        *keys, *[F.col(f"e.{p}.{c}").cast("double").alias(f"_{p}{c}") for p in "ab" for c in "xy"])
    first, last = F.ceil(F.least("_ay", "_by") - 0.5), F.ceil(F.greatest("_ay", "_by") - 0.5) - 1
    told = edges.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    edge = F.struct("_first", "_last", "_ax", "_ay", "_bx", "_by").alias("_e")
    bands = told.select(*keys, edge, F.explode(F.sequence(F.floor(F.col("_first") / BAND), F.floor(F.col("_last") / BAND))).alias("_band"))
    grouped = bands.groupBy(*keys, "_band").agg(F.collect_list("_e").alias("_edges"))
    low, high = F.col("_band") * BAND, F.col("_band") * BAND + BAND - 1

    def crossings(e: Column) -> Column:
        x = lambda row: e["_ax"] + (row + 0.5 - e["_ay"]) * (e["_bx"] - e["_ax"]) / (e["_by"] - e["_ay"])
        return F.transform(F.sequence(F.greatest(e["_first"], low), F.least(e["_last"], high)), lambda row: F.struct(row.alias("row"), x(row).alias("x")))

    # a closed polygon crosses every row an even number of times, so the pairs of a band's sorted crossings are those of its rows
    sorted_x = grouped.select(*keys, F.array_sort(F.flatten(F.transform("_edges", crossings))).alias("_x"))
    cell = lambda k: F.ceil(F.get("_x", k)["x"] - 0.5)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda k: F.struct(F.get("_x", k)["row"].alias("row"), cell(k).alias("x0"), cell(k + 1).alias("x1")))
    return sorted_x.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.row", "r.x0", "r.x1").filter("x0 < x1")


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the runs of each key, as disjoint runs that do not touch."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.select(*keys, "x0", "x1").withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(1)))
    numbered = begun.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def common_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What runs of a and of b share."""
    other = b.select(*keys, F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    low, high = F.greatest("x0", "_b0"), F.least("x1", "_b1")
    return a.join(other, keys).filter(low < high).select(*keys, low.alias("x0"), high.alias("x1"))


def runs_without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of the runs of a without those of b; further columns of a stay. A run of a meets as many of b as it has cells at most."""
    other = merged_runs(b, keys).select(*keys, F.struct(F.col("x0").alias("s"), F.col("x1").alias("e")).alias("_cut"))
    met = (F.col("_cut.s") < F.col("x1")) & (F.col("_cut.e") > F.col("x0"))
    # runs of a that nothing of b meets have no cuts, and are whole
    other = other.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_b_{k}") for k in keys]
    cuts = a.join(other, [*on, met], "left").groupBy(*a.columns).agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda k: F.struct(F.coalesce(F.get("_cuts", k - 1)["e"], F.col("x0")).alias("s"), F.coalesce(F.get("_cuts", k)["s"], F.col("x1")).alias("e")),
    )
    others = [c for c in a.columns if c not in ("x0", "x1")]
    return cuts.select(*others, F.explode(gaps).alias("g")).select(*others, F.col("g.s").alias("x0"), F.col("g.e").alias("x1")).filter("x0 < x1")


def _moved(runs: DataFrame, rows: int, grow: int = 0) -> DataFrame:
    return runs.withColumns({"row": F.col("row") + rows, "x0": F.col("x0") - grow, "x1": F.col("x1") + grow})


def edge_runs(masks: DataFrame, layer: list[str]) -> DataFrame:
    """The cells of each mask with a neighbour above, below, left or right that is not of it: a row's runs without what is
    inside them and in the runs of the rows above and below. layer: what identifies a mask besides the row."""
    own = merged_runs(masks, [*layer, "row"])
    return runs_without(own, _inner_runs(own, layer), [*layer, "row"])


def _inner_runs(own: DataFrame, layer: list[str]) -> DataFrame:
    """The cells of each mask, as merged runs, whose four neighbours are of it too."""
    keys = [*layer, "row"]
    inside = _moved(own, 0, -1).filter("x0 < x1")
    return common_runs(common_runs(inside, _moved(own, 1), keys), _moved(own, -1), keys)


def ring_runs(masks: DataFrame, image: list[str], inst: str, reach: int = 1) -> DataFrame:
    """The cells around each mask, up to `reach` rows and columns away, that are in no mask of the image."""
    keys = [*image, inst, "row"]
    rows = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d")
    grown = _moved(masks.select(*keys, "x0", "x1", rows).withColumn("row", F.col("row") + F.col("_d")).drop("_d"), 0, reach)
    return runs_without(merged_runs(grown, keys).select(*keys, "x0", "x1"), masks.select(*image, "row", "x0", "x1"), [*image, "row"])


def _cells(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


#: Columns of a block in which runs meet the values of cells.
BLOCK = 64


def contour_features(masks: DataFrame, cells: DataFrame, image: list[str], inst: str, value: str, reach: int = 1) -> DataFrame:
    """(image, inst, area, edge, ring, inside, around, contrast) of each mask: cells of it, of its edge and of the ring
    around it, the mean value of the cells (image, row, x, value) in it and in the ring, and their difference.

    Runs and rings are written once. Runs meet the cells with a value in blocks of BLOCK columns, so masks are not spelt out.
    """
    keys = [*image, inst]
    own = written(merged_runs(masks, [*keys, "row"]), "masks")
    ring = written(ring_runs(own, image, inst, reach), "rings")
    size = lambda df, name: df.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias(name))
    both = own.withColumn("_in", F.lit(True)).unionByName(ring.withColumn("_in", F.lit(False)))
    blocks = both.withColumn("_block", F.explode(F.sequence(F.floor(F.col("x0") / BLOCK), F.floor((F.col("x1") - 1) / BLOCK))))
    placed = cells.select(*image, "row", "x", F.col(value).alias("_v"), F.floor(F.col("x") / BLOCK).alias("_block"))
    seen = blocks.join(placed, [*image, "row", "_block"]).filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    means = seen.groupBy(*keys).agg(F.avg(F.when(F.col("_in"), F.col("_v"))).alias("inside"), F.avg(F.when(~F.col("_in"), F.col("_v"))).alias("around"))
    inner = size(_inner_runs(own, keys), "_inner")  # the other cells of a mask are its edge
    out = size(own, "area").join(inner, keys, "left").join(size(ring, "ring"), keys, "left").join(means, keys, "left")
    zero = F.lit(0).cast("long")
    told = out.withColumns({"edge": F.col("area") - F.coalesce("_inner", zero), "ring": F.coalesce("ring", zero), "contrast": F.col("around") - F.col("inside")})
    return told.select(*keys, "area", "edge", "ring", "inside", "around", "contrast")


def touching_runs(masks: DataFrame, image: list[str], inst: str, reach: int) -> DataFrame:
    """(image, row, x0, x1) of the cells of a mask that have a cell of another mask of the image within `reach` rows and columns."""
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d")
    other = _moved(masks.select(*image, F.col(inst).alias("_other"), "row", "x0", "x1", near).withColumn("row", F.col("row") + F.col("_d")).drop("_d"), 0, reach)
    keys = [*image, "row"]
    b = other.select(*keys, "_other", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    low, high = F.greatest("x0", "_b0"), F.least("x1", "_b1")
    met = masks.join(b, keys).filter((F.col(inst) != F.col("_other")) & (low < high))
    return merged_runs(met.select(*keys, low.alias("x0"), high.alias("x1")), keys)


def touch_votes(masks: DataFrame, image: str, record: str, inst: str, reach: int) -> DataFrame:
    """(image, row, x, touch): the share of an image's records in which a cell lies where two masks touch; cells without a vote have no row."""
    n = masks.groupBy(image).agg(F.count_distinct(record).alias("_n"))
    cells = _cells(touching_runs(masks, [image, record], inst, reach), [image, record, "row"])
    return cells.groupBy(image, "row", "x").agg(F.count(F.lit(1)).alias("_v")).join(n, image).select(image, "row", "x", (F.col("_v") / F.col("_n")).alias("touch"))


def confirm_grid(scored: DataFrame, hits: DataFrame, n_true: DataFrame, score: str, supported: str, highs: list[float], lows: list[float]) -> DataFrame:
    """(high, low, s, tp, fp, fn, pq) of every pair of thresholds, high >= low, of the rule 'score > high, or score > low
    and supported'.

    scored: (image, a, score, supported) of each prediction; hits: its pairs (image, a, b, iou) that count. Predictions are
    counted by the bins of the two thresholds that their score passes, truths by the bins of the best score that found them
    with and without support; a pair of thresholds is a sum over bins. So predictions and truths are read once, whatever
    the number of pairs, and the bins are (highs + 1) x (lows + 1) rows at most.
    """
    passed = lambda x, cuts: F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(cuts)]), lambda c: c < x))
    per = scored.join(hits.groupBy("image", "a").agg(F.sum("iou").alias("_s"), F.count(F.lit(1)).alias("_h")), ["image", "a"], "left")
    bins = [passed(F.col(score), highs).alias("i"), F.when(F.col(supported), passed(F.col(score), lows)).otherwise(0).alias("j")]
    of_pred = per.select(*bins, F.coalesce("_s", F.lit(0.0)).alias("s"), F.coalesce("_h", F.lit(0)).alias("h"))
    of_pred = of_pred.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("h").alias("tp"), F.count_if(F.col("h") == 0).alias("fp"), F.lit(0).cast("long").alias("found"))
    best = hits.join(scored, ["image", "a"]).groupBy("image", "b").agg(F.max(score).alias("_any"), F.max(F.when(F.col(supported), F.col(score))).alias("_sup"))
    zero = F.lit(0).cast("long")
    of_true = best.select(passed(F.col("_any"), highs).alias("i"), F.when(F.col("_sup").isNotNull(), passed(F.col("_sup"), lows)).otherwise(0).alias("j"))
    of_true = of_true.groupBy("i", "j").agg(F.lit(0.0).alias("s"), zero.alias("tp"), zero.alias("fp"), F.count(F.lit(1)).alias("found"))
    grid = [(k, m, float(h), float(low)) for k, h in enumerate(sorted(highs)) for m, low in enumerate(sorted(lows)) if h >= low]
    pairs = scored.sparkSession.createDataFrame(grid, "k int, m int, high double, low double")
    told = F.broadcast(pairs).crossJoin(of_pred.unionByName(of_true))  # both sides are bounded by the thresholds
    kept = (F.col("i") > F.col("k")) | (F.col("j") > F.col("m"))
    add = lambda c: F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).alias(c)
    out = told.groupBy("high", "low").agg(*[add(c) for c in ("s", "tp", "fp", "found")])
    out = out.crossJoin(F.broadcast(n_true.agg(F.count(F.lit(1)).alias("_n")))).withColumn("fn", F.col("_n") - F.col("found"))  # one row
    whole = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    return out.select("high", "low", "s", "tp", "fp", "fn", F.when(whole > 0, F.col("s") / whole).otherwise(0.0).alias("pq"))


def slot_picks(rows: DataFrame, keys: list[str], row: str, score: str, slots: dict[str, list[Column]]) -> DataFrame:
    """(keys, slot, tier, row, score): for each named slot the best row of its first tier that has one, the smallest row on a tie.

    slots: the conditions of each slot's tiers, first one first. A row is exploded to the first tier of each slot that takes it.
    """
    tiers = []
    for name, conditions in slots.items():
        tier = F.lit(None).cast("int")
        for k in reversed(range(len(conditions))):
            tier = F.when(conditions[k], k).otherwise(tier)
        tiers.append(F.struct(F.lit(name).alias("slot"), tier.alias("tier")))
    open_ = rows.select(*keys, row, score, F.explode(F.array(*tiers)).alias("_t")).select(*keys, row, score, "_t.*").filter("tier is not null")
    order = F.struct(F.col("tier"), (-F.col(score)).alias("_s"), F.col(row))
    return open_.groupBy(*keys, "slot").agg(F.min(F.struct(order.alias("_o"), F.col("tier"), F.col(row), F.col(score))).alias("_b")).select(
        *keys, "slot", "_b.tier", f"_b.{row}", f"_b.{score}")


def size_projection(subsets: DataFrame, keys: list[str], size: str, value: str) -> DataFrame:
    """(keys, sizes, slope, limit): the mean value of all subsets of a size, fitted against 1 / size; limit is the value at endless size."""
    means = subsets.groupBy(*keys, size).agg(F.avg(value).alias("_m")).withColumn("_x", 1 / F.col(size))
    return means.groupBy(*keys).agg(F.count(F.lit(1)).alias("sizes"), F.regr_slope("_m", "_x").alias("slope"), F.regr_intercept("_m", "_x").alias("limit"))


def loss_attribution(losses: DataFrame, keys: list[str], variant: str, loss: str, cube: list[list[str]], cls: list[str], base: str, other: str) -> DataFrame:
    """The loss of two variants and its share and change by each grouping of classes in `cube`; a class that a grouping leaves out
    is 'all'. One scan: rows are aggregated by all classes and variants first, and the groupings are sums of these."""
    fine = losses.groupBy(*keys, *cls).pivot(variant, [base, other]).agg(F.sum(loss))
    named = fine.select(*keys, *cls, F.coalesce(F.col(base), F.lit(0.0)).alias("_a"), F.coalesce(F.col(other), F.lit(0.0)).alias("_b"))
    sets = F.explode(F.array(*[F.struct(*[(F.col(c).cast("string") if c in own else F.lit("all")).alias(c) for c in cls]) for own in cube])).alias("_g")
    out = named.select(*keys, sets, "_a", "_b").groupBy(*keys, *[F.col(f"_g.{c}").alias(c) for c in cls]).agg(F.sum("_a").alias("loss"), F.sum("_b").alias("other"))
    total = named.groupBy(*keys).agg(F.sum("_a").alias("_t"))
    return out.join(total, keys).select(*keys, *cls, "loss", (F.col("loss") / F.col("_t")).alias("share"), (F.col("other") - F.col("loss")).alias("change"))
