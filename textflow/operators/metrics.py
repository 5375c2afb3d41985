"""Scores of a prediction table, as one-row aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, prediction: str = "prediction", label: str = "label",
             digits: int | None = 6) -> DataFrame:
    """One row ``(accuracy double)``: correct / total, one aggregate."""
    a = F.avg((F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double"))
    out = pred.agg(a.alias("accuracy"))
    return out.select(F.round("accuracy", digits).alias("accuracy")) if digits is not None else out


def evaluate(pred: DataFrame, metric: str = "accuracy", prediction: str = "prediction",
             label: str = "label") -> float:
    """A multiclass metric through Spark's evaluator (returns a number)."""
    ev = MulticlassClassificationEvaluator(predictionCol=prediction, labelCol=label, metricName=metric)
    return float(ev.evaluate(pred.select(F.col(prediction).cast("double").alias(prediction),
                                         F.col(label).cast("double").alias(label))))


def rmse(pred: DataFrame, prediction: str = "prediction", label: str = "label",
         digits: int | None = 6) -> DataFrame:
    """One row ``(rmse double)``: square root of the mean squared error."""
    e = F.sqrt(F.avg(F.pow(F.col(prediction).cast("double") - F.col(label).cast("double"), 2)))
    out = pred.agg(e.alias("rmse"))
    return out.select(F.round("rmse", digits).alias("rmse")) if digits is not None else out


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, to read an accuracy against the majority share."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def report(pred: DataFrame, prediction: str = "prediction", label: str = "label",
           digits: int = 6) -> DataFrame:
    """One row: ``accuracy``, ``rows``, ``positives`` and ``majority_share``
    (the accuracy of always answering the larger class), so an accuracy can
    be read against the class balance. One aggregate pass."""
    y = F.col(label).cast("double")
    hit = (F.col(prediction).cast("double") == y).cast("double")
    agg = pred.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows"),
                   F.sum((y == 1).cast("long")).alias("positives"))
    share = F.greatest(F.col("positives"), F.col("rows") - F.col("positives")) / F.col("rows")
    return agg.select(F.round("accuracy", digits).alias("accuracy"), "rows", "positives",
                      F.round(share, digits).alias("majority_share"))
