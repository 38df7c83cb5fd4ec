"""Smoothing inside runs: total variation and Whittaker, many runs of one length at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class _Slope:
    """The derivative of a convex piecewise quadratic function of one variable: linear pieces between knots (place, change of
    slope, jump), known from its outermost pieces (slope, value at 0) on both sides."""

    def __init__(self) -> None:
        self.knots: deque[tuple[float, float, float]] = deque()
        self.low, self.high = [0.0, 0.0], [0.0, 0.0]

    def add_distance(self, to: float, weight: float) -> None:
        """Adds weight * |x - to|."""
        at = next((k for k, (x, _, _) in enumerate(self.knots) if x >= to), len(self.knots))
        self.knots.insert(at, (to, 0.0, 2 * weight))
        self.low[1] -= weight
        self.high[1] += weight

    def add_square(self, to: float) -> None:
        """Adds (x - to)^2 / 2."""
        for piece in (self.low, self.high):
            piece[0] += 1.0
            piece[1] -= to

    def cut_low(self, value: float) -> float:
        """Raises the derivative to `value` where it is below; the place from where on it is not."""
        slope, rest = self.low
        at = None
        while self.knots:
            x, change, jump = self.knots[0]
            here = slope * x + rest
            if here >= value:
                break
            self.knots.popleft()
            slope, rest, at = slope + change, rest + jump - change * x, x
            if here + jump >= value:
                self.knots.appendleft((x, slope, here + jump - value))
                self.low = [0.0, value]
                return x
        at = (value - rest) / slope if slope > 0 else at
        self.knots.appendleft((at, slope, 0.0))
        self.low = [0.0, value]
        return at

    def cut_high(self, value: float) -> float:
        """Lowers the derivative to `value` where it is above; the place up to which it is not."""
        slope, rest = self.high
        at = None
        while self.knots:
            x, change, jump = self.knots[-1]
            here = slope * x + rest
            if here <= value:
                break
            self.knots.pop()
            slope, rest, at = slope - change, rest - jump + change * x, x
            if here - jump <= value:
                self.knots.append((x, -slope, value - here + jump))
                self.high = [0.0, value]
                return x
        at = (value - rest) / slope if slope > 0 else at
        self.knots.append((at, -slope, 0.0))
        self.high = [0.0, value]
        return at


def total_variation(y: np.ndarray, lam: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None, anchor: np.ndarray | None = None) -> np.ndarray:
    """Each row's minimiser of |x - y|^2 / 2 + lam * sum |x_{i+1} - x_i| + anchor * (|x_1 - left| + |x_n - right|), NaN being no anchor.

    Exact, by dynamic programming (Johnson, A dynamic programming algorithm for the fused lasso, 2013): the best cost of the
    first i values as a function of the next one has a derivative that is the one before, plus a line, cut off at -lam and lam;
    walking back, each value is the next one, held between the two places where its derivative was cut. Linear in n.
    """
    out = np.empty(y.shape)
    for r, (row, strength) in enumerate(zip(y.tolist(), lam.tolist(), strict=True)):
        ends = [None if e is None or anchor is None or not np.isfinite(e[r]) else (float(e[r]), float(anchor[r])) for e in (left, right)]
        cost, held = _Slope(), []
        if ends[0]:
            cost.add_distance(*ends[0])
        for value in row[:-1]:
            cost.add_square(value)
            held.append((cost.cut_low(-strength), cost.cut_high(strength)))
        cost.add_square(row[-1])
        if ends[1]:
            cost.add_distance(*ends[1])
        x = out[r, -1] = cost.cut_low(0.0)
        for k in range(len(held) - 1, -1, -1):
            x = out[r, k] = min(max(x, held[k][0]), held[k][1])
    return out


def whittaker(y: np.ndarray, lam: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None, anchor: np.ndarray | None = None) -> np.ndarray:
    """Each row's minimiser of |x - y|^2 + lam * sum (x_{i+1} - x_i)^2 + anchor * ((x_1 - left)^2 + (x_n - right)^2), NaN being no anchor.

    One tridiagonal system a row, all rows at once.
    """
    m, n = y.shape
    neighbours = np.where(np.arange(n) == 0, 0.0, 1.0) + np.where(np.arange(n) == n - 1, 0.0, 1.0)
    diagonal, rhs = 1 + lam[:, None] * neighbours, y.astype(float).copy()
    for at, end in ((0, left), (-1, right)):
        if end is not None and anchor is not None:
            known = np.isfinite(end)
            diagonal[known, at] += anchor[known]
            rhs[known, at] += anchor[known] * end[known]
    c, d = np.zeros((m, n)), np.zeros((m, n))
    c[:, 0], d[:, 0] = -lam / diagonal[:, 0], rhs[:, 0] / diagonal[:, 0]
    for k in range(1, n):
        rest = diagonal[:, k] + lam * c[:, k - 1]
        c[:, k], d[:, k] = -lam / rest, (rhs[:, k] + lam * d[:, k - 1]) / rest
    for k in range(n - 2, -1, -1):
        d[:, k] -= c[:, k] * d[:, k + 1]
    return d


def smooth_runs(df: DataFrame, keys: list[str], order: str, value: str, how: str, strength: float, anchor: float = 0.0, left: str | None = None, right: str | None = None) -> DataFrame:
    """Value inside each run smoothed; strengths are relative to the run's mean (tv) or absolute (whittaker).

    df has run_start and run_end of its runs, and in left and right the observed values beside a run, NULL where there are
    none. Runs become arrays; each task solves the runs of a batch, those of one length together. A run is one array.
    """
    ends = [F.first(c).cast("double").alias(n) if c else F.lit(None).cast("double").alias(n) for c, n in ((left, "left_end"), (right, "right_end"))]
    runs = df.groupBy(*keys, "run_start", "run_end").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("y"), *ends)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            out: list = [None] * len(frame)
            for _, rows in frame.groupby(frame["y"].map(len).to_numpy()).groups.items():
                y = np.array([frame["y"].iloc[k] for k in rows], float)
                level = np.abs(y.mean(axis=1)) if how == "tv" else np.ones(len(y))
                solver = total_variation if how == "tv" else whittaker
                beside = [frame[c].iloc[rows].to_numpy(float) for c in ("left_end", "right_end")]
                for k, x in zip(rows, solver(y, strength * level, *beside, anchor * level if anchor else None), strict=True):
                    out[k] = x.tolist()
            yield frame.assign(x=pd.Series(out, dtype=object))

    schema = StructType([*runs.schema.fields, StructField("x", ArrayType(DoubleType()))])
    solved = runs.mapInPandas(solve, schema)
    return solved.select(*keys, "run_start", "run_end", F.posexplode(F.arrays_zip("y", "x")).alias("_k", "_z")).select(
        *keys, "run_start", "run_end", (F.col("run_start") + F.col("_k")).alias(order), F.col("_z.y").alias(value), F.col("_z.x").alias("smoothed")
    )
