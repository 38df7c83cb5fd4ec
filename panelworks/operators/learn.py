"""Spark ML in folds: residual regression, out-of-fold scores, isotonic calibration, keep filters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import space
from panelworks.sources.files import written


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep").transform(df)


#: Kinds or steps that a model each is fitted for, at most.
MOST_KINDS = 32


def _few(df: DataFrame, column: str) -> list:
    """The different values of a column; ValueError if there are more than MOST_KINDS."""
    found = df.select(column).distinct().orderBy(column).limit(MOST_KINDS + 1).collect()
    if len(found) > MOST_KINDS:
        raise ValueError(f"{column} has more than {MOST_KINDS} values, each of which would be a model")
    return found


def residual_fit(df: DataFrame, features: list[str], target: str, baseline: str, weight: str, kind: str, trees: int = 10, depth: int = 3, seed: int = 1) -> DataFrame:
    """For each kind of row a boosted model of target - baseline, added to the baseline again: column fitted.

    kind is a column of few values; rows of unknown target are scored, not fitted.
    """
    data = _assembled(df.withColumn("_r", F.col(target) - F.col(baseline)), features)
    parts = []
    for row in _few(df, kind):
        own = data.filter(F.col(kind).eqNullSafe(F.lit(row[kind])))
        model = GBTRegressor(featuresCol="_f", labelCol="_r", weightCol=weight, maxIter=trees, maxDepth=depth, seed=seed).fit(own.filter("_r is not null"))
        parts.append(model.transform(own).withColumn("fitted", F.col(baseline) + F.col("prediction")))
    return reduce(DataFrame.unionByName, parts).drop("_f", "_r", "prediction")


def out_of_fold(df: DataFrame, features: list[str], y: str, fold: str, folds: int, weight: str | None = None, trees: int = 10, depth: int = 3, seed: int = 1) -> DataFrame:
    """Score of every row from a boosted classifier of the other folds: column p, NULL where those have no label.

    The rows are written once: every fit and the scores read them from there.
    """
    data = _assembled(written(df, "folds"), features)
    labelled = {r[fold] for r in data.filter(F.col(y).isNotNull() & F.col(fold).isin(list(range(folds)))).select(fold).distinct().collect()}
    parts = []
    for k in range(folds):
        own = data.filter(F.col(fold) == k)
        if not labelled - {k}:
            parts.append(own.withColumn("p", F.lit(None).cast("double")))
            continue
        learner = GBTClassifier(featuresCol="_f", labelCol=y, maxIter=trees, maxDepth=depth, seed=seed)
        if weight:
            learner = learner.setWeightCol(weight)
        model = learner.fit(data.filter((F.col(fold) != k) & F.col(y).isNotNull()))
        parts.append(model.transform(own).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction"))
    return reduce(DataFrame.unionByName, parts).drop("_f")


def stack(df: DataFrame, keys: list[str], pos: str, metres: str, p: str, cut: float, y: str, fold: str, folds: int, weight: str | None = None, trees: int = 10, depth: int = 3) -> DataFrame:
    """Second-stage scores, column stacked, from the first stage's out-of-fold p: what the profile of p along the axis looks
    like at a row (W18), the mass beside it (W17) and the block of p at the cut or over that it is in or before (W19)."""
    from panelworks.operators import runs

    shape = space.band_mass(space.profile(df, keys, pos, metres, p), keys, metres, p, [500, 1000, 2000]).withColumnsRenamed({"head": "head_share", "tail": "tail_share"})
    told = runs.block_geometry(shape.withColumn("_flag", F.col(p) >= cut), keys, pos, "_flag", p)
    away = {"to_tail": F.coalesce(F.col(pos) - F.col("tail"), F.lit(-99)), "to_head": F.coalesce(F.col("head") - F.col(pos), F.lit(-99)), "block_length": F.coalesce("block_length", F.lit(0)), "block_mass": F.coalesce("block_mass", F.lit(0.0))}
    told = told.withColumns(away).withColumnRenamed(p, "first")
    names = ["first", "p_max", "p_sum", "p_rel", "p_rank", "off_best", "m_best", "head_share", "tail_share", *[f"mass_{s}_{r}" for s in ("dn", "up") for r in (500, 1000, 2000)], *away, "n_blocks"]
    return out_of_fold(told, names, y, fold, folds, weight, trees, depth).withColumnsRenamed({"p": "stacked", "first": p})


#: Slot and position steps to the neighbours that a hidden cell is judged by.
AROUND = [(-1, 0), (1, 0), (-2, 0), (2, 0), (0, -1), (0, 1), (0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)]
#: What stands for a missing neighbour in the features; ratios are not negative.
MISSING = -1.0


def impute_states(df: DataFrame, keys: list[str], slot: str, pos: str, ratio: str, guess: str, fold: str, folds: int, cut: float = 1.0, near: float = 1.3, trees: int = 20, depth: int = 4) -> DataFrame:
    """Whether a cell is at the cut or under it, learned for cells without a ratio from their twelve neighbours.

    df (keys, slot, pos, ratio, guess, fold), one row for a cell, missing cells as rows with a NULL ratio. A model of the other
    folds scores each fold. It is fitted on observed cells that are, or have an observed cell beside them in slot or position
    or both, at `near` or under: their own ratio is hidden, as it is no feature. The features are the neighbours' ratios and
    the means of the two next in slot and of the two next in position.

    Adds p (score of every cell, observed ones too, so that it can be checked), by_time and by_space (the two means at the cut
    or under; NULL without a mean), learned (the observed state, else p >= 0.5 where any neighbour is observed, else false) and
    hybrid (the observed state; within one slot and two positions of an observed cell at the cut or under what the model says;
    elsewhere `guess`).
    """
    wide = [(a, b) for a in (-1, 0, 1) for b in range(-2, 3) if (a, b) not in AROUND and (a, b) != (0, 0)]
    name = lambda d: f"c_{d[0]}_{d[1]}".replace("-", "m")
    cells = space.neighbour_cells(df, keys, slot, pos, ratio, AROUND + wide)
    mean = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2
    cells = cells.withColumns({"_time": mean(F.col(name((-1, 0))), F.col(name((1, 0)))), "_space": mean(F.col(name((0, -1))), F.col(name((0, 1))))})
    least = lambda found: F.least(*[F.coalesce(c, F.lit(float("inf"))) for c in found])
    state = F.col(ratio) <= cut
    close = least([F.col(name((a, b))) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)] + [F.col(ratio)]) <= near
    told = cells.withColumns(
        {
            "_y": F.when(close, state.cast("double")),
            "_any": F.coalesce(*[F.col(name(d)) for d in AROUND]).isNotNull(),
            "_by_positive": least([F.col(name((a, b))) for a in (-1, 0, 1) for b in range(-2, 3) if (a, b) != (0, 0)]) <= cut,
            "by_time": F.col("_time") <= cut,
            "by_space": F.col("_space") <= cut,
            **{f"_x{k}": F.coalesce(c, F.lit(MISSING)) for k, c in enumerate([F.col(name(d)) for d in AROUND] + [F.col("_time"), F.col("_space")])},
        }
    )
    told = told.drop(*[name(d) for d in AROUND + wide])
    features = [f"_x{k}" for k in range(len(AROUND) + 2)]
    scored = out_of_fold(told, features, "_y", fold, folds, trees=trees, depth=depth)
    model = F.coalesce(F.col("p") >= 0.5, F.lit(False))  # no model: no cell near the cut
    labels = {"learned": F.coalesce(state, model & F.col("_any")), "hybrid": F.coalesce(state, F.when(F.col("_by_positive"), model).otherwise(F.col(guess)))}
    return scored.withColumns(labels).drop(*features, "_time", "_space", "_y", "_any", "_by_positive")


def isotonic_oof(df: DataFrame, p: str, y: str, fold: str, step: str, folds: int) -> DataFrame:
    """P calibrated by an isotonic fit on the other folds of the same step: column calibrated. Steps are few."""
    parts = []
    for s in [r[step] for r in _few(df, step)]:
        own = df.filter(F.col(step) == s)
        for k in range(folds):
            model = IsotonicRegression(featuresCol=p, labelCol=y).fit(own.filter((F.col(fold) != k) & F.col(y).isNotNull()))
            parts.append(model.transform(own.filter(F.col(fold) == k)).withColumnRenamed("prediction", "calibrated"))
    return reduce(DataFrame.unionByName, parts)
