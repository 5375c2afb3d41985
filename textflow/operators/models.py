"""Classifiers and model selection on a ``label`` / ``features`` table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lineage_cut
from .metrics import accuracy
from .optimality import best_stump, descent
from .sampling import with_split

# Each classifier's settings, to match.
DEFAULTS = {
    "random_forest": {"numTrees": 10},
    "perceptron": {"maxIter": 1000, "blockSize": 128, "seed": 1234, "hidden": (30, 24)},
    "linear_svm": {"maxIter": 10, "regParam": 0.1},
    "logistic": {"maxIter": 10, "regParam": 0.3, "elasticNetParam": 0.8},
}


# Rows that are worth a part of their own in a fit of many iterations, and those that a part holds at most.
LEAST_ROWS, MOST_ROWS = 1 << 11, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in equal parts for a fit of many iterations, which waits for its largest part in each:
    as many as the session has cores, fewer for few rows, more for very many. Files as they were written may be unequal."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS)))


def feature_width(df: DataFrame, features: str = "features") -> int:
    """Width of a vector column: from ML attribute metadata when present,
    else from one row."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    row = df.select(features).where(F.col(features).isNotNull()).head()
    if row is None:
        raise ValueError("empty feature table")
    return int(row[0].size)


def estimator(kind: str, features: str = "features", label: str = "label", seed: int = 24,
              n_features: int | None = None, n_classes: int = 2, **params):
    p = {**DEFAULTS.get(kind, {}), **params}
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed, **p)
    if kind == "perceptron":
        hidden = p.pop("hidden")
        layers = p.pop("layers", None) or [n_features, *hidden, n_classes]
        return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, **p)
    if kind == "linear_svm":
        return LinearSVC(featuresCol=features, labelCol=label, **p)
    if kind == "logistic":
        return LogisticRegression(featuresCol=features, labelCol=label, **p)
    raise ValueError(f"unknown classifier {kind!r}")


def train(df: DataFrame, kind: str = "random_forest", features: str = "features",
          label: str = "label", seed: int = 24, **params):
    """Fit one classifier. For the perceptron the first layer is the
    feature width of the data, which is dealt out evenly, as each of its iterations passes over all rows."""
    n = feature_width(df, features) if kind == "perceptron" and "layers" not in params else None
    df = spread(df.select(features, label)) if kind == "perceptron" else df
    return estimator(kind, features, label, seed, n_features=n, **params).fit(df)


def predict(model, df: DataFrame) -> DataFrame:
    """Score rows; the label column travels with each row, so predictions
    never need to be matched to labels by position."""
    return model.transform(df)


def logistic_grid(est: LogisticRegression):
    """Twelve settings: regParam {0.1, 0.01} x fitIntercept {False, True} x
    elasticNetParam {0.0, 0.5, 1.0}."""
    # fixed values: the settings to match
    return (ParamGridBuilder().addGrid(est.regParam, [0.1, 0.01])
            .addGrid(est.fitIntercept, [False, True])
            .addGrid(est.elasticNetParam, [0.0, 0.5, 1.0]).build())


def learned(model, df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row ``(gap double)``: what a fitted classifier falls short by on the rows it was
    fitted on. For linear models the share of the objective that a step against its subgradient
    still saves (``optimality.descent``); for others how far the accuracy lies below that of the best threshold on one feature."""
    if isinstance(model, (LogisticRegressionModel, LinearSVCModel)):
        logistic = isinstance(model, LogisticRegressionModel)
        gap = descent(df, "logistic" if logistic else "linear_svm", model.coefficients.toArray(), model.intercept, model.getRegParam(),
                      model.getElasticNetParam() if logistic else 0.0, model.getFitIntercept(), features, label)
        return df.sparkSession.createDataFrame([(gap,)], "gap double")
    own = accuracy(predict(model, df), label=label, digits=None)
    return own.crossJoin(best_stump(df, features, label).withColumnRenamed("accuracy", "stump")).select(
        F.greatest(F.lit(0.0), F.col("stump") - F.col("accuracy")).alias("gap"))  # one row each


def _evaluator(metric: str, label: str):
    if metric == "rmse":
        return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    if metric == "logloss":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")
    if metric == "areaUnderROC":
        return BinaryClassificationEvaluator(labelCol=label)
    return MulticlassClassificationEvaluator(labelCol=label, metricName=metric)


def tune(df: DataFrame, est, grid, train_ratio: float = 0.8, metric: str = "rmse",
         label: str = "label", key: str = "vec_id", seed: int = 24, parallelism: int = 4):
    """One train/validation split by a hash of ``key``, shared by all settings
    (so that it doesn't follow the layout); every grid setting fitted (``parallelism`` at a time) on its part 0
    and scored by ``metric`` on part 1. On a tie the first setting in grid order wins, and is
    fitted on all rows. Returns the best model and a table
    ``(setting int, params string, score double, best boolean)``."""
    # a hash of its own, or a table that was split by the same key and seed would fall into one part
    parted = lineage_cut(with_split(df, (train_ratio, 1 - train_ratio), key, f"{seed}:fold", "__fold"))
    train_rows, held = (parted.where(F.col("__fold") == i).drop("__fold") for i in (0, 1))
    evaluator = _evaluator(metric, label)

    def score(setting):
        return float(evaluator.evaluate(est.fit(train_rows, setting).transform(held)))

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        scores = list(pool.map(score, grid))
    sign = -1 if evaluator.isLargerBetter() else 1
    best = min(range(len(scores)), key=lambda i: (sign * scores[i], i))
    model = est.fit(parted.drop("__fold"), grid[best])
    rows = []
    for i, (pm, s) in enumerate(zip(grid, scores, strict=True)):
        desc = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        rows.append((i, desc, float(s), i == best))
    table = df.sparkSession.createDataFrame(rows, "setting int, params string, score double, best boolean")
    return model, table
