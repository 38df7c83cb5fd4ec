"""Flows and blocks: incidence products, projections of weight tables onto totals, block dynamics, rule forecasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incidence_product(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Total of the flows over each link. edges (link, path), flows (path, f)."""
    return edges.join(flows, "path").groupBy("link").agg(F.sum("f").alias("total"))


def incidence_transpose(edges: DataFrame, duals: DataFrame) -> DataFrame:
    """J22, transposed: sum of the links' values along each path. duals (link, mu)."""
    return edges.join(duals, "link").groupBy("path").agg(F.sum("mu").alias("t"))


def crossings(paths: DataFrame) -> DataFrame:
    """The segments k that a path from o to d crosses, o <= k < d; ranges are exploded, nothing is compared."""
    return paths.filter("o < d").select("path", F.explode(F.sequence(F.col("o").cast("long"), (F.col("d") - 1).cast("long"))).alias("link"))


def screenlines(edges: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """The segment of each link that all paths with o <= segment < d use, and no others; NULL for the links that are none.

    edges (keys, link, path), paths (keys, path, o, d), one row for a path. The only segment that a link can stand for is the
    last origin among its paths. They all cross it if none ends at or before it, and they are all that do if they are as many;
    how many cross it is a running sum of starts less ends over the positions of a key. So sets are compared exactly without
    a set being gathered or a range exploded. Repeated edges count once; a link with a path of unknown range is none.
    """
    used = edges.select(*keys, "link", "path").distinct().join(paths, [*keys, "path"], "left")
    links = used.groupBy(*keys, "link").agg(
        F.count(F.lit(1)).alias("n_paths"), F.max("o").alias("_k"), F.min("d").alias("_first_end"), F.count_if(F.col("o").isNull() | F.col("d").isNull()).alias("_unknown")
    )
    ends = F.explode(F.array(F.struct(F.col("o").alias("at"), F.lit(1).alias("by")), F.struct(F.col("d").alias("at"), F.lit(-1).alias("by"))))
    steps = paths.filter("o < d").select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.at").alias("_k")).agg(F.sum("e.by").alias("_by"))
    run = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    crossing = steps.select(*keys, "_k", F.sum("_by").over(run).alias("_crossing"))
    pure = (F.col("_unknown") == 0) & (F.col("_first_end") > F.col("_k")) & (F.col("n_paths") == F.col("_crossing"))
    return links.join(crossing, [*keys, "_k"], "left").select(*keys, "link", "n_paths", F.when(pure, F.col("_k")).alias("segment"))


def attachment_validity(grid: DataFrame, attachments: DataFrame, sensors: DataFrame) -> DataFrame:
    """Whether any sensor attached to a link is valid at a slot; true for links that list none.

    grid (slot, link), attachments (link, sensor), sensors (slot, sensor, valid).
    """
    seen = sensors.join(attachments, "sensor").groupBy("slot", "link").agg(F.bool_or("valid").alias("any_valid"))
    lists = attachments.select("link").distinct().withColumn("has", F.lit(True))
    out = grid.join(lists, "link", "left").join(seen, ["slot", "link"], "left")
    return out.select("slot", "link", F.coalesce("any_valid", F.col("has").isNull()).alias("ok"))


def trip_scores(estimate: DataFrame, truth: DataFrame, edges: DataFrame, weights: tuple[float, float, float, float] = (0.35, 0.35, 0.15, 0.15)) -> DataFrame:
    """Agreement of two flow tables (panel, path, dest, f): by path, by link, of the total, by destination, and the weighted sum.

    Agreement is 1 - sum |difference| / sum truth, at least 0; of the total it is exp(-|ratio - 1|).
    """
    both = estimate.withColumnRenamed("f", "e").join(truth.withColumnRenamed("f", "t"), ["panel", "path", "dest"], "full").fillna(0.0, ["e", "t"])

    def agreement(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("panel").agg(F.greatest(F.lit(0.0), 1 - F.sum(F.abs(F.col("e") - F.col("t"))) / F.sum("t")).alias(name))

    sums = [F.sum("e").alias("e"), F.sum("t").alias("t")]
    by_link = both.join(edges, "path").groupBy("panel", "link").agg(*sums)
    total = both.groupBy("panel").agg(*sums).select("panel", F.exp(-F.abs(F.col("e") / F.col("t") - 1)).alias("s_total"))
    out = agreement(both, "s_path").join(agreement(by_link, "s_link"), "panel").join(total, "panel").join(agreement(both.groupBy("panel", "dest").agg(*sums), "s_dest"), "panel")
    return out.withColumn("score", sum(w * F.col(c) for w, c in zip(weights, ("s_path", "s_link", "s_total", "s_dest"), strict=True)))


def compare_estimates(estimates: DataFrame, truth: DataFrame, edges: DataFrame, families: DataFrame) -> DataFrame:
    """(estimator, family, n_panels, the means of trip_scores() over the panels of a family, overall): estimators held
    against the same truth. overall is the mean score of an estimator's families, whatever the number of panels in each.

    estimates (estimator, panel, path, dest, f), truth (panel, path, dest, f), families (panel, family). A path that an
    estimate lacks is zero there; every estimator is held against every path of the panels that it has any path of.
    """
    pair = F.struct("estimator", "panel").alias("panel")
    owed = estimates.select("estimator", "panel").distinct().join(truth, "panel").select(pair, "path", "dest", "f")
    scored = trip_scores(estimates.select(pair, "path", "dest", "f"), owed, edges)
    names = ["s_path", "s_link", "s_total", "s_dest", "score"]
    told = scored.select("panel.estimator", "panel.panel", *names).join(families, "panel")
    means = told.groupBy("estimator", "family").agg(F.count(F.lit(1)).alias("n_panels"), *[F.avg(c).alias(c) for c in names])
    return means.withColumn("overall", F.avg("score").over(Window.partitionBy("estimator")))


MAX_TOTALS = 512


def project(rows: DataFrame, edges: DataFrame, totals: DataFrame, kind: str = "kl", ridge: float = 0.0, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """The table nearest to b whose sums over each total's rows are c; rows (path, b), edges (link, path), totals (link, c).

    kind: kl multiplies b by exp, l2 adds and cuts at 0, chi2 adds in proportion to b. ridge > 0 lets totals be missed at
    that price (l2, chi2). The dual is solved by damped Newton steps: rows stay distributed, each round two sums of at
    most MAX_TOTALS and its square come to the driver. Rows with the same totals and b are one row with a count.
    """
    links = [r["link"] for r in totals.select("link").orderBy("link").limit(MAX_TOTALS + 1).collect()]
    if not 0 < len(links) <= MAX_TOTALS:
        raise ValueError(f"from 1 to {MAX_TOTALS} totals")
    c = np.array([r["c"] for r in totals.orderBy("link").collect()], float)
    number = F.create_map(*[F.lit(x) for k, link in enumerate(links) for x in (link, k)])
    own = edges.groupBy("path").agg(F.array_sort(F.collect_set(number[F.col("link")])).alias("s"))
    base = rows.join(own, "path", "left").withColumn("s", F.coalesce("s", F.array().cast("array<int>"))).withColumn("b", F.greatest("b", F.lit(1e-12)))
    grouped = base.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).persist()

    def value(mu: np.ndarray):
        t = F.aggregate("s", F.lit(0.0), lambda a, k: a + F.array(*[F.lit(float(x)) for x in mu])[k])
        if kind == "kl":
            return F.col("b") * F.exp(F.least(F.greatest(t, F.lit(-50.0)), F.lit(50.0)))
        return F.greatest(F.lit(0.0), F.col("b") + (F.col("b") if kind == "chi2" else F.lit(1.0)) * t)

    def sums(mu: np.ndarray, hessian: bool):
        f = value(mu)
        slope = f if kind == "kl" else F.when(f > 0, F.col("b") if kind == "chi2" else F.lit(1.0)).otherwise(0.0)
        told = grouped.withColumn("f", f * F.col("n")).withColumn("h", slope * F.col("n"))
        g = np.zeros(len(links))
        for r in told.select(F.explode("s").alias("k"), "f").groupBy("k").agg(F.sum("f").alias("f")).collect():
            g[r["k"]] = r["f"]
        h = np.zeros((len(links), len(links)))
        if hessian:
            pairs = told.filter("h > 0").select(F.explode("s").alias("k"), "s", "h").select("k", F.explode("s").alias("l"), "h")
            for r in pairs.groupBy("k", "l").agg(F.sum("h").alias("h")).collect():
                h[r["k"], r["l"]] = r["h"]
        return g - c + ridge * mu, h + (ridge + 1e-10) * np.eye(len(links))

    mu = np.zeros(len(links))
    try:
        g, h = sums(mu, True)
        for _ in range(rounds):
            if np.max(np.abs(g) / np.maximum(np.abs(c), 1e-9)) < tolerance:
                break
            step, a = np.linalg.lstsq(h, g, rcond=1e-12)[0], 1.0
            while a > 1e-4:
                next_g, next_h = sums(mu - a * step, True)
                if np.linalg.norm(next_g) < (1 - 1e-4 * a) * np.linalg.norm(g):
                    break
                a /= 2
            mu, g, h = mu - a * step, next_g, next_h
    finally:
        grouped.unpersist()
    return base.select("path", value(mu).alias("f"))


def extrapolate_blocks(now: DataFrame, before: DataFrame, keys: list[str], lag: int, steps: int, most: float, axis: int) -> DataFrame:
    """Each block's head and tail move on as they have since `lag` slots ago, at most `most` places a slot; cells of each step."""
    from panelworks.operators.runs import overlap_match

    m = overlap_match(now, before, keys)
    speed = lambda a, b: F.coalesce(F.least(F.greatest((F.col(a) - F.col(b)) / lag, F.lit(-most)), F.lit(most)), F.lit(0.0))
    stepped = m.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    first = F.greatest(F.bround(F.col("run_start") + speed("run_start", "before_start") * F.col("step")).cast("long"), F.lit(0))
    last = F.least(F.bround(F.col("run_end") + speed("run_end", "before_end") * F.col("step")).cast("long"), F.lit(axis - 1))
    drawn = stepped.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b")
    return drawn.select(*keys, "step", F.explode(F.sequence("_a", "_b")).alias("link")).distinct()


def shock_speed(df: DataFrame, keys: list[str], order: str, flag: str, flow: str, density: str, reach: int, least: float) -> DataFrame:
    """At each block's tail and head, change of mean flow over change of mean density across the edge; NULL where the density hardly changes."""
    from panelworks.operators.runs import mark_runs

    w = Window.partitionBy(*keys).orderBy(order)
    means = {f"{n}_{s}": F.avg(c).over(w.rowsBetween(*f)) for n, c in (("q", flow), ("k", density)) for s, f in (("in", (0, reach - 1)), ("out", (-reach, -1)), ("end", (-reach + 1, 0)), ("next", (1, reach)))}
    blocks = mark_runs(df.withColumns(means), keys, order, flag)
    tail = F.when(F.abs(F.col("k_in") - F.col("k_out")) >= least, (F.col("q_in") - F.col("q_out")) / (F.col("k_in") - F.col("k_out")))
    head = F.when(F.abs(F.col("k_next") - F.col("k_end")) >= least, (F.col("q_next") - F.col("q_end")) / (F.col("k_next") - F.col("k_end")))
    return blocks.groupBy(*keys, "run_start", "run_end").agg(F.max(F.when(F.col(order) == F.col("run_start"), tail)).alias("tail_speed"), F.max(F.when(F.col(order) == F.col("run_end"), head)).alias("head_speed"))


def persistence(df: DataFrame, origins: DataFrame, keys: list[str], unit: list[str], order: str, value: str, cut: float, back: int, steps: int) -> DataFrame:
    """The last value within `back` slots before an origin, at or under the cut, for each of the next steps."""
    seen = origins.withColumn("_d", F.explode(F.sequence(F.lit(-back).cast("long"), F.lit(-1).cast("long")))).withColumn(order, F.col("origin") + F.col("_d"))
    hist = seen.join(df.filter(F.col(value).isNotNull()), [*keys, order]).groupBy(*keys, "origin", *unit).agg(F.max_by(value, order).alias("last"), F.max("_d").alias("age"))
    return hist.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long")))).withColumn("active", F.col("last") <= cut)


def masked_check(df: DataFrame, keys: list[str], order: str, value: str, hide: str, cut: float) -> DataFrame:
    """Cells that `hide` names are hidden, filled by interpolation, and held against the truth: accuracy, recall, specificity of being under the cut;
    recall is NULL where no truth is under it, specificity where all are."""
    from panelworks.operators.fill import interpolate

    shown = df.withColumn("_v", F.when(~F.expr(hide), F.col(value)))
    out = interpolate(shown, keys, order, "_v", edges=True).filter(F.expr(hide) & F.col(value).isNotNull())
    y, p = F.col(value) <= cut, F.coalesce(F.col("filled") <= cut, F.lit(False))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((y == p).cast("double")).alias("accuracy"), F.try_divide(F.count_if(y & p), F.count_if(y)).alias("recall"), F.try_divide(F.count_if(~y & ~p), F.count_if(~y)).alias("specificity"))
