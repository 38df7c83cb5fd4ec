"""Instance masks as run tables (image, record, inst, row, x0, x1), half open: overlap, panoptic quality, fusion, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def areas(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of each instance; its runs in a row do not overlap."""
    return masks.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def overlaps(a: DataFrame, b: DataFrame, inst: str = "inst") -> DataFrame:
    """(image, a, b, inter, area_a, area_b, iou) of the pairs that meet. Runs are joined on (image, row)."""
    x = a.select("image", "row", F.col(inst).alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"))
    y = b.select("image", "row", F.col(inst).alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    shared = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    met = x.join(y, ["image", "row"]).filter(shared > 0).groupBy("image", "a", "b").agg(F.sum(shared).alias("inter"))
    out = met.join(areas(a, ["image", inst]).withColumnsRenamed({inst: "a", "area": "area_a"}), ["image", "a"])
    out = out.join(areas(b, ["image", inst]).withColumnsRenamed({inst: "b", "area": "area_b"}), ["image", "b"])
    return out.withColumn("iou", F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")))


def panoptic_quality(pred: DataFrame, true: DataFrame, at: float = 0.5) -> DataFrame:
    """Pooled sum of IoU over hits, hits, predictions and truths without a hit; every pair over the bound is a hit."""
    hit = overlaps(pred, true).filter(F.col("iou") > at)
    n_pred = pred.select("image", F.col("inst").alias("a")).distinct().join(hit.select("image", "a").distinct(), ["image", "a"], "left_anti")
    n_true = true.select("image", F.col("inst").alias("b")).distinct().join(hit.select("image", "b").distinct(), ["image", "b"], "left_anti")
    s = hit.agg(F.coalesce(F.sum("iou"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("tp"))
    s = s.crossJoin(n_pred.agg(F.count(F.lit(1)).alias("fp"))).crossJoin(n_true.agg(F.count(F.lit(1)).alias("fn")))  # one row each
    d = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    return s.withColumn("pq", F.when(d > 0, F.col("s") / d).otherwise(0.0))


def area_percentiles(masks: DataFrame, shares: list[float]) -> DataFrame:
    """N instances and percentiles of their areas, p<100 * share>, interpolated; areas are counted by value first."""
    counts = areas(masks, ["image", "inst"]).groupBy("area").agg(F.count(F.lit(1)).alias("_n"))
    of = [F.percentile("area", F.lit(s), F.col("_n")).alias(f"p{round(100 * s)}") for s in shares]
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), *of)


def match_targets(pred: DataFrame, true: DataFrame, at: float = 0.5) -> DataFrame:
    """For each prediction the share of the image's records with a hit, and its mean best IoU over those."""
    records = true.select("image", "record").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    keyed = true.withColumn("inst", F.struct("record", "inst"))
    best = overlaps(pred, keyed).groupBy("image", "a", F.col("b.record").alias("record")).agg(F.max("iou").alias("m"))
    hits = best.filter(F.col("m") > at).groupBy("image", "a").agg(F.count(F.lit(1)).alias("h"), F.avg("m").alias("mean_iou"))
    all_ = pred.select("image", F.col("inst").alias("a")).distinct().join(records, "image", "left").join(hits, ["image", "a"], "left")
    return all_.select("image", F.col("a").alias("inst"), F.coalesce(F.col("h") / F.col("n"), F.lit(0.0)).alias("hit_share"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def confirm(a: DataFrame, b: DataFrame, scores: DataFrame, high: float, low: float, at: float) -> DataFrame:
    """Instances of a with score > high, or > low and an IoU over `at` with an instance of b."""
    best = overlaps(a, b).groupBy("image", F.col("a").alias("inst")).agg(F.max("iou").alias("m"))
    out = scores.join(best, ["image", "inst"], "left")
    return out.filter((F.col("score") > high) | ((F.col("score") > low) & (F.coalesce("m", F.lit(0.0)) > at))).drop("m")


def fuse(a: DataFrame, b: DataFrame, scores_a: DataFrame, scores_b: DataFrame, high: float, low: float, at: float, add: float, cover: float) -> DataFrame:
    """What confirm() keeps of a, and instances of b with score >= add of which no kept one covers `cover` of the area."""
    kept = confirm(a, b, scores_a, high, low, at).withColumn("source", F.lit("a"))
    covered = overlaps(a, b).join(kept.select("image", F.col("inst").alias("a")), ["image", "a"], "left_semi").groupBy("image", F.col("b").alias("inst")).agg(F.max(F.col("inter") / F.col("area_b")).alias("c"))
    added = scores_b.join(covered, ["image", "inst"], "left").filter((F.col("score") >= add) & (F.coalesce("c", F.lit(0.0)) < cover)).drop("c").withColumn("source", F.lit("b"))
    return kept.unionByName(added)


def component_features(cells: DataFrame, keys: list[str], x: str, y: str, p: str, near: float) -> DataFrame:
    """Area, mean, max, percentiles, share over 0.7, bounding-box fill, elongation (of the axes of the cells' covariance, 1 under
    five cells), distance to the nearest centroid and neighbours within `near`.

    Centroids meet those of the same image only; an image's instances are few.
    """
    f = cells.groupBy(*keys, "inst").agg(
        F.count(F.lit(1)).alias("area"), F.avg(p).alias("mean_p"), F.max(p).alias("max_p"), F.percentile(p, F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.avg((F.col(p) > 0.7).cast("double")).alias("share_high"),
        (F.count(F.lit(1)) / ((F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1))).alias("fill"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"),
    )
    middle, half = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, F.lit(2)) + F.col("_xy") * F.col("_xy"))
    long, short = F.greatest(middle + half, F.lit(1e-3)), F.greatest(middle - half, F.lit(1e-3))
    f = f.withColumn("elongation", F.when(F.col("area") >= 5, F.sqrt(long / short)).otherwise(1.0)).drop("_xx", "_yy", "_xy")
    other = f.select(*keys, F.col("inst").alias("_i"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    d = F.sqrt(F.pow(F.col("cx") - F.col("_x"), 2) + F.pow(F.col("cy") - F.col("_y"), 2))
    dist = f.join(other, keys).filter("inst <> _i").groupBy(*keys, "inst").agg(F.min(d).alias("nearest"), F.count_if(d < near).alias("neighbours"))
    return f.join(dist, [*keys, "inst"], "left").withColumns({"p50": F.col("q")[0], "p90": F.col("q")[1], "neighbours": F.coalesce("neighbours", F.lit(0).cast("long"))}).drop("q")


def vote_shares(cells: DataFrame, keys: list[str], record: str, n_records: DataFrame) -> DataFrame:
    """Share of an image's records that hold each cell."""
    return cells.groupBy("image", *keys).agg(F.count_distinct(record).alias("v")).join(n_records, "image").select("image", *keys, (F.col("v") / F.col("n")).alias("vote"))


def threshold_grid(pred: DataFrame, true: DataFrame, scores: DataFrame, cuts: list[float], at: float = 0.5) -> DataFrame:
    """Panoptic quality at every score threshold, all thresholds in one aggregation over the overlaps."""
    grid = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    kept = scores.select("image", F.col("inst").alias("a"), "score", grid).filter(F.col("score") >= F.col("cut")).drop("score")
    hit = overlaps(pred, true).filter(F.col("iou") > at).select("image", "a", "b", "iou")
    per = kept.join(hit, ["image", "a"], "left")
    rows = per.groupBy("cut", "image", "a").agg(F.sum("iou").alias("s"), F.count("iou").alias("h"))
    tp = rows.groupBy("cut").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.sum("h").alias("tp"), F.count_if(F.col("h") == 0).alias("fp"))
    found = per.filter("b is not null").groupBy("cut").agg(F.count_distinct("image", "b").alias("found"))
    n = true.select("image", "inst").distinct().agg(F.count(F.lit(1)).alias("n"))
    out = tp.join(found, "cut", "left").crossJoin(n).withColumn("fn", F.col("n") - F.coalesce("found", F.lit(0)))  # n is one row
    return out.withColumn("pq", F.col("s") / (F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))).select("cut", "s", "tp", "fp", "fn", "pq")


def owner_cells(cells: DataFrame, keys: list[str], confidence: str, least: int = 1) -> DataFrame:
    """Each cell to its most confident instance, the smaller number on a tie; instances with the cells left to them, `least` or more."""
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).desc(), "inst")
    own = cells.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return own.groupBy("image", "inst").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") >= least)


def connected_cells(cells: DataFrame, keys: list[str], x: str, y: str, least: int = 1, reach: int = 1, score: str | None = None, least_score: float = 0.0) -> DataFrame:
    """8-connected components of the cells of each key, as the component's first cell (ox, oy); of `least` cells or more.

    With a reach over 1, fragments that are so many rows and columns apart at most are one component (documented change: a
    square in place of an ellipse). score: a column whose mean over the component must be least_score or more.

    Labels pass to the neighbours and jump to their label's label; each round is checkpointed in the shared folder.
    """
    from panelworks.sources.files import checkpointed

    own = checkpointed(cells.groupBy(*keys, x, y).agg(F.max(score or F.lit(0.0)).alias("_score")).withColumn("o", F.struct(F.col(x).alias("ox"), F.col(y).alias("oy"))))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    while True:
        sent = own.select(*keys, x, y, "o", around.alias("d")).select(*keys, (F.col(x) + F.col("d.a")).alias(x), (F.col(y) + F.col("d.b")).alias(y), "o")
        got = sent.groupBy(*keys, x, y).agg(F.min("o").alias("n"))
        near = own.join(got, [*keys, x, y])
        far = near.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("n").alias("f"))
        at = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.n.ox") == F.col("r._x"), F.col("l.n.oy") == F.col("r._y")]
        after = checkpointed(near.alias("l").join(far.alias("r"), at).select(*[F.col(f"l.{k}") for k in [*keys, x, y, "_score"]], F.col("l.o").alias("old"), F.least("l.n", "r.f").alias("o")))
        changed = after.filter("old <> o").limit(1).count()
        own = after.drop("old")
        if not changed:
            break
    w = Window.partitionBy(*keys, "o")
    kept = own.withColumn("cells", F.count(F.lit(1)).over(w)).withColumn("_mean", F.avg("_score").over(w)).filter(F.col("cells") >= least)
    kept = kept.filter(F.col("_mean") >= least_score) if score else kept
    return kept.select(*keys, x, y, "o.ox", "o.oy", "cells")
