"""Checks of fitted classifiers against the data they were fitted on.

A linear model minimises a known objective, so no step against its
subgradient may lower it by much: ``descent`` measures by how much the best of
some steps does, relative to the objective. A tree ensemble or a perceptron has no such
certificate; it must at least tell its own rows apart as well as the best
single threshold on one feature does: ``best_stump``.

Both are a few passes that add up sums, of a size set by the number of features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import vector_items

# Lengths of the steps that are tried.
STEPS = tuple(10.0 ** e for e in np.arange(-4, 1.01, 0.5))


def _batches(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(vector_items(features, "float64").alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")


def _totals(df: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all rows of ``of(x, y)``, an array of ``width`` numbers for a batch."""
    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += of(batch.column("x").flatten().to_numpy().reshape(len(batch), -1), batch.column("y").to_numpy())
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})

    return np.array([r.total for r in df.mapInArrow(add, "total array<double>").collect()]).sum(axis=0)  # a row for each task


def _loss(kind: str, margin: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope by the margin."""
    if kind == "linear_svm":
        return np.maximum(0, 1 - sign * margin), np.where(sign * margin < 1, -sign, 0.0)
    return np.logaddexp(0, -sign * margin), -sign / (1 + np.exp(np.clip(sign * margin, -500, 500)))


def descent(df: DataFrame, kind: str, weights, intercept: float, reg: float, l1: float = 0.0, fit_intercept: bool = True,
            features: str = "features", label: str = "label") -> float:
    """How far a step against the subgradient lowers the objective of a linear model
    (``logistic`` or ``linear_svm``), relative to its value: the mean loss plus ``reg`` times the elastic
    net (share ``l1`` of the absolute values) of the weights of standardised features."""
    rows = _batches(df, features, label)
    w = np.asarray(weights, np.float64)
    d = len(w)
    sums = _totals(rows, 2 * d + 1, lambda x, y: np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, mean = sums[0], sums[1:d + 1] / sums[0]
    std = np.sqrt(np.maximum(sums[d + 1:] / n - mean ** 2, 0) * n / max(n - 1, 1))
    safe = np.where(std > 0, std, 1.0)
    u = w * std

    def penalty(v):
        return reg * (l1 * np.abs(v).sum() + (1 - l1) / 2 * (v * v).sum())

    def slopes(x, y):
        sign = np.where(y > 0, 1.0, -1.0)
        loss, slope = _loss(kind, x @ w + intercept, sign)
        return np.concatenate([[loss.sum(), slope.sum()], slope @ (x / safe * (std > 0))])

    found = _totals(rows, d + 2, slopes) / n
    smooth = found[2:] + reg * (1 - l1) * u
    pull = reg * l1
    # the shortest subgradient: at zero the absolute value takes up to its slope
    slope = np.where(u != 0, smooth + pull * np.sign(u), np.sign(smooth) * np.maximum(np.abs(smooth) - pull, 0))
    down = found[1] if fit_intercept else 0.0
    here = found[0] + penalty(u)
    points = [(u - s * slope, intercept - s * down) for s in STEPS]
    stretched = np.array([p / safe for p, _ in points]).T
    shifts = np.array([b for _, b in points])

    def losses(x, y):
        sign = np.where(y > 0, 1.0, -1.0)[:, None]
        return _loss(kind, x @ stretched + shifts, sign)[0].sum(axis=0)

    there = _totals(rows, len(STEPS), losses) / n + [penalty(p) for p, _ in points]
    return float(max(0.0, here - there.min()) / here)


def best_stump(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row ``(accuracy double)``: that of the best threshold on one feature, or of the
    larger class alone."""
    values = _batches(df, features, label).select("y", F.posexplode("x").alias("feature", "value"))
    counted = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("ones"))
    # below and at each value; a feature's different values are in one window
    up = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    sums = counted.select(F.sum("n").over(up).alias("n"), F.sum("ones").over(up).alias("ones"),
                          F.sum("n").over(whole).alias("all"), F.sum("ones").over(whole).alias("all_ones"))
    zeros_below = (F.col("n") - F.col("ones")) + (F.col("all_ones") - F.col("ones"))  # 0 up to the threshold, 1 beyond
    right = F.greatest(zeros_below, F.col("all") - zeros_below, F.col("all_ones"), F.col("all") - F.col("all_ones"))
    return sums.agg(F.max(right / F.col("all")).alias("accuracy"))
