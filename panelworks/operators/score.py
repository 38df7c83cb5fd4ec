"""Scores: AUC, hierarchical means, state and conservation scores, medians, raters, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Masked ROC-AUC of each key, exact with ties, NULL for one class. Distinct scores are counted before they are sorted."""
    counts = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("_w", F.col("pos") * (below + F.col("neg") / 2))
    out = wins.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg")))).drop("_w")


def macro(df: DataFrame, score: str) -> DataFrame:
    """A10: mean score, strict (NULL if any is) and lenient."""
    return df.agg(F.when(F.count(score) == F.count(F.lit(1)), F.avg(score)).alias("macro_strict"), F.avg(score).alias("macro_lenient"))


def hierarchical_mean(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean over rows by all levels, then over each level from the last, up to one number; a row for each step."""
    out, step, parts = df, value, []
    for depth in range(len(levels), -1, -1):
        keys = levels[:depth]
        out = (out.groupBy(*keys) if keys else out).agg(F.avg(step).alias("mean"))
        step = "mean"
        parts.append(out.select(F.lit(depth).alias("depth"), *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in levels], "mean"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def set_iou(df: DataFrame, keys: list[str], predicted: str, true: str) -> DataFrame:
    """Share of the union that both hold; an empty union counts 1."""
    a, b = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(true), F.lit(False))
    union = F.count_if(a | b)
    return df.groupBy(*keys).agg(F.when(union == 0, 1.0).otherwise(F.count_if(a & b) / union).alias("iou"))


def state_score(df: DataFrame, keys: list[str], speed_error: Column, flow_error: Column) -> DataFrame:
    """0.54 max(0, 1 - RMSE of speed / 25) + 0.46 max(0, 1 - RMSE of flow / 600)."""
    rmse = lambda e: F.sqrt(F.avg(e * e))
    part = lambda r, scale: F.greatest(F.lit(0.0), 1 - r / scale)
    return df.groupBy(*keys).agg(rmse(speed_error).alias("rmse_speed"), rmse(flow_error).alias("rmse_flow")).withColumn("score", 0.54 * part(F.col("rmse_speed"), 25) + 0.46 * part(F.col("rmse_flow"), 600))


def conservation_score(df: DataFrame, keys: list[str], unit: list[str], order: str, submitted: str, true: str) -> DataFrame:
    """1 - min(1, sum |change submitted - change true| / sum |change true|) over consecutive valid rows."""
    w = Window.partitionBy(*unit).orderBy(order)
    steps = df.withColumns({"_o": F.lead(order).over(w), "_s": F.lead(submitted).over(w) - F.col(submitted), "_t": F.lead(true).over(w) - F.col(true)}).filter(F.col("_o") == F.col(order) + 1)
    return steps.groupBy(*keys).agg((1 - F.least(F.lit(1.0), F.sum(F.abs(F.col("_s") - F.col("_t"))) / F.sum(F.abs("_t")))).alias("score"))


def mixed_rate_score(df: DataFrame, keys: list[str], error: str, dark: str, shares: DataFrame) -> DataFrame:
    """(1 - share) * MSE of regular rows + share * MSE of dark rows, the share from a small table."""
    e = F.col(error) * F.col(error)
    own = df.groupBy(*keys).agg(F.avg(F.when(~F.col(dark), e)).alias("mse_regular"), F.avg(F.when(F.col(dark), e)).alias("mse_dark"))
    return own.join(shares, keys).withColumn("mixed", (1 - F.col("share")) * F.col("mse_regular") + F.col("share") * F.col("mse_dark"))


def error_budget(df: DataFrame, keys: list[str], cls: list[str], error: str) -> DataFrame:
    """Rows, MSE and share of the key's squared error by class."""
    own = df.groupBy(*keys, *cls).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(error) * F.col(error)).alias("mse"), F.sum(F.col(error) * F.col(error)).alias("_sse"))
    return own.withColumn("share", F.col("_sse") / F.sum("_sse").over(Window.partitionBy(*keys))).drop("_sse")


def group_weights(df: DataFrame, group: list[str], kind: list[str]) -> DataFrame:
    """Weights that give every group the same sum and rows a mean of 1 within a kind."""
    w = 1 / F.count(F.lit(1)).over(Window.partitionBy(*kind, *group))
    out = df.withColumn("_w", w)
    return out.withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(*kind))).drop("_w")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value whose cumulative weight is half the total or more. Equal values are summed first."""
    once = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    k = Window.partitionBy(*keys)
    cum = F.sum("_w").over(k.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("_c", cum).withColumn("_t", F.sum("_w").over(k)).filter(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def sign_majority(df: DataFrame, keys: list[str], value: str, weight: str, top: int, tie: str) -> DataFrame:
    """Of the rows with the sign of the weighted majority: median, weighted mean, and median of the `top` heaviest."""
    k = Window.partitionBy(*keys)
    major = F.sign(F.sum(F.sign(value) * F.col(weight)).over(k))
    kept = df.withColumn("_m", major).filter(F.sign(value) == F.col("_m"))
    kept = kept.withColumn("_n", F.row_number().over(k.orderBy(F.col(weight).desc(), tie)))
    return kept.groupBy(*keys).agg(F.median(value).alias("median"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.median(F.when(F.col("_n") <= top, F.col(value))).alias("top_median"))


def rater_consensus(df: DataFrame, key: str, rater: str, value: str, off: float = 0.5) -> DataFrame:
    """Values off the key's median by more than a share go; mean, deviation, raters left, and each rater's error against the mean of the others."""
    k = Window.partitionBy(key)
    kept = df.withColumn("_m", F.median(value).over(k)).filter(F.abs(F.col(value) - F.col("_m")) <= off * F.abs("_m"))
    n, total = F.count(F.lit(1)).over(k), F.sum(value).over(k)
    return kept.select(key, rater, value, n.alias("n_raters"), (total / n).alias("consensus"), F.stddev_pop(value).over(k).alias("spread"), F.when(n > 1, F.col(value) - (total - F.col(value)) / (n - 1)).alias("loo_error"))


def diagnostics(df: DataFrame, keys: list[str], estimate: str, reference: str) -> DataFrame:
    """Rows, mean, bias, mean absolute error before and after the bias is taken out, correlation."""
    d = F.col(estimate) - F.col(reference)
    known = df.select(*keys, estimate, reference, d.alias("_d"))
    whole = known.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg(estimate).alias("mean"), F.avg("_d").alias("bias"), F.avg(F.abs("_d")).alias("mad"), F.corr(estimate, reference).alias("corr"))
    # errors are counted by value and meet their key's bias, so no task holds a key's rows; biases of few keys are broadcast
    counts = known.filter("_d is not null").groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    same = lambda tag: [F.col(c).eqNullSafe(F.col(f"{tag}{c}")) for c in keys]
    biases = whole.select(*[F.col(c).alias(f"_b_{c}") for c in keys], F.col("bias").alias("_b"))
    away = counts.join(biases, same("_b_")).groupBy(*[F.col(c).alias(f"_a_{c}") for c in keys]).agg((F.sum(F.col("_n") * F.abs(F.col("_d") - F.col("_b"))) / F.sum("_n")).alias("mad_debiased"))
    return whole.join(away, same("_a_"), "left").select(*keys, "n", "mean", "bias", "mad", "mad_debiased", "corr")


def robust_line(df: DataFrame, keys: list[str], x: str, y: str, passes: int = 2, least: int = 10) -> DataFrame:
    """Least squares, then passes that leave out residuals over their 90th percentile while enough points stay."""
    k = Window.partitionBy(*keys)
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for _ in range(passes):
        fit = kept.withColumn("_r", F.abs(F.col(y) - F.regr_slope(y, x).over(k) * F.col(x) - F.regr_intercept(y, x).over(k)))
        fit = fit.withColumn("_c", F.percentile("_r", 0.9).over(k)).withColumn("_n", F.count(F.lit(1)).over(k))
        kept = fit.filter((F.col("_n") < least) | (F.col("_r") <= F.col("_c") + 1e-9)).drop("_r", "_c", "_n")
    return kept.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def angle_mode(df: DataFrame, keys: list[str], angle: str, weight: str, width: float) -> DataFrame:
    """Heaviest bin of the weighted angle histogram after a mean over five bins; the first on a tie."""
    bins = df.groupBy(*keys, F.floor(F.col(angle) / width).alias("bin")).agg(F.sum(weight).alias("_w"))
    smooth = F.sum("_w").over(Window.partitionBy(*keys).orderBy("bin").rangeBetween(-2, 2)) / 5
    out = bins.withColumn("_s", F.round(smooth, 6))
    best = out.groupBy(*keys).agg(F.max_by(F.struct("bin", "_s"), F.struct("_s", (-F.col("bin")).alias("o"))).alias("b"))
    return best.select(*keys, F.col("b.bin").alias("bin"), ((F.col("b.bin") + 0.5) * width).alias("mode"), F.col("b._s").alias("mass"))


def axes_of_points(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted centre, major and minor deviation, elongation and angle of a point set, by the closed form of a 2 x 2 covariance."""
    s = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(F.col(w) * F.col(x)).alias("_x"), F.sum(F.col(w) * F.col(y)).alias("_y"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("_xx"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("_yy"), F.sum(F.col(w) * F.col(x) * F.col(y)).alias("_xy"))
    cx, cy = F.col("_x") / F.col("_w"), F.col("_y") / F.col("_w")
    sxx, syy, sxy = F.col("_xx") / F.col("_w") - cx * cx, F.col("_yy") / F.col("_w") - cy * cy, F.col("_xy") / F.col("_w") - cx * cy
    root = F.sqrt(F.pow((sxx - syy) / 2, F.lit(2)) + sxy * sxy)
    major, minor = F.sqrt((sxx + syy) / 2 + root), F.sqrt(F.greatest((sxx + syy) / 2 - root, F.lit(0.0)))
    return s.select(*keys, cx.alias("cx"), cy.alias("cy"), major.alias("major"), minor.alias("minor"), (major / F.greatest(minor, F.lit(1e-6))).alias("elongation"), F.degrees(0.5 * F.atan2(2 * sxy, sxx - syy)).alias("angle"))


def through_origin(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope sum(xy) / sum(x^2), R^2 against zero, and spread of ln(y / x) over positive pairs."""
    both = (F.col(x) > 0) & (F.col(y) > 0)
    s = df.groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("_xy"), F.sum(F.col(x) * F.col(x)).alias("_xx"), F.sum(F.col(y) * F.col(y)).alias("_yy"), F.stddev_pop(F.when(both, F.log(F.col(y) / F.col(x)))).alias("log_spread"))
    return s.select(*keys, (F.col("_xy") / F.col("_xx")).alias("slope"), (F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy"))).alias("r2"), "log_spread")


def poisson_bootstrap(df: DataFrame, key: str, levels: list[str], delta: str, replicates: int, seed: int = 0) -> DataFrame:
    """A27 (documented change: Poisson weights by hash in place of a multinomial draw): hierarchical mean difference, its
    deviation, share of replicates at or below 0, keys better and worse."""
    u = (F.pmod(F.xxhash64(key, "rep", F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    w, below = F.lit(0), 0.0
    term = 2.718281828459045**-1
    for k in range(8):  # inverse of the Poisson(1) distribution function
        below += term
        w = w + F.when(u > below, 1).otherwise(0)
        term /= k + 1
    drawn = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("_w", F.when(F.col("rep") == 0, 1).otherwise(w))
    out = drawn.groupBy("rep", *levels).agg((F.sum(F.col("_w") * F.col(delta)) / F.sum("_w")).alias("m")).filter("m is not null")
    for depth in range(len(levels) - 1, -1, -1):
        out = out.groupBy("rep", *levels[:depth]).agg(F.avg("m").alias("m"))
    stats = out.agg(F.max(F.when(F.col("rep") == 0, F.col("m"))).alias("delta"), F.stddev(F.when(F.col("rep") > 0, F.col("m"))).alias("se"), F.avg(F.when(F.col("rep") > 0, (F.col("m") <= 0).cast("double"))).alias("p_not_better"))
    return stats.crossJoin(df.agg(F.count_if(F.col(delta) > 0).alias("better"), F.count_if(F.col(delta) < 0).alias("worse")))  # one row each
