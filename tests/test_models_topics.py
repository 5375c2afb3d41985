import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textflow.operators import metrics as ME
from textflow.operators import models as MO
from textflow.operators import optimality as OP
from textflow.operators import term_index as TI
from textflow.operators import topic_tables as TT
from textflow.operators import topics as TO


def toy(spark, n=400, width=6, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        v = [rnd.gauss(1.5 if y else -1.5, 1.0) if j < 2 else rnd.gauss(0, 1) for j in range(width)]
        rows.append((i, y, Vectors.dense(v)))
    return spark.createDataFrame(rows, ["id", "label", "features"])


def test_classifiers_beat_majority_and_repeat(spark):
    df = toy(spark)
    for kind, params in [("random_forest", {}), ("logistic", {}), ("linear_svm", {}),
                         ("perceptron", {"maxIter": 200})]:
        model = MO.train(df, kind, seed=7, **params)
        pred = MO.predict(model, df)
        acc = ME.accuracy(pred).first().accuracy
        assert acc > 0.8, (kind, acc)
        assert abs(ME.evaluate(pred, "accuracy") - acc) < 1e-6
        again = MO.predict(MO.train(df, kind, seed=7, **params), df)
        assert ME.accuracy(again).first().accuracy == acc


def test_tune_grid_and_tie_rule(spark):
    df = toy(spark)
    est = MO.estimator("logistic")
    model, table = MO.tune(df, est, MO.logistic_grid(est), 0.8, "rmse", key="id", parallelism=2)
    rows = table.orderBy("setting").collect()
    assert len(rows) == 12 and sum(r.best for r in rows) == 1
    best = [r for r in rows if r.best][0]
    assert best.score == min(r.score for r in rows)
    assert best.setting == min(r.setting for r in rows if r.score == best.score)


def test_rmse_is_sqrt_of_error_rate(spark):
    pred = spark.createDataFrame([(1.0, 1), (0.0, 1), (0.0, 0), (1.0, 1)], "prediction double, label int")
    acc = ME.accuracy(pred).first().accuracy
    assert abs(ME.rmse(pred).first().rmse - (1 - acc) ** 0.5) < 1e-6


def test_topics(spark):
    docs = [["apple", "banana", "apple", "fruit"], ["car", "road", "car"], ["apple", "fruit"],
            ["road", "truck", "car"], ["banana", "fruit"]] * 5 + [["zzz"]]
    df = spark.createDataFrame([(i, i % 2, d) for i, d in enumerate(docs)], "id int, target int, f array<string>")
    rows = TI.numbered(df)
    index = TI.fit_term_index(rows, "f", min_df=2.0)
    feats = TI.term_vectors(rows, index, "f")
    m = TO.fit_topics(feats, "id", k=3, max_iter=10)
    mixed = TO.topic_mixture(m, feats).collect()
    for r in mixed:
        total = sum(r.topicDistribution.toArray())
        assert abs(total - (0.0 if r.f == ["zzz"] else 1.0)) < 1e-6
    vocabulary = index.table.select("index", "term")
    held = {r.term for r in vocabulary.collect()}
    terms = TO.topic_terms(m, vocabulary, 2).collect()
    assert len(terms) == 6 and all(r.term in held for r in terms)
    words = TO.topic_words(TO.topic_terms(m, vocabulary, 2)).collect()
    assert all(len(r.topics_words) == 2 for r in words)
    _, by_class = TO.topics_by_class(feats, "id", "target", (0, 1), k=3, max_iter=5)
    for r in by_class.collect():
        assert len(r.topic) == 6
        zero_half = r.topic[3:] if r.target == 0 else r.topic[:3]
        assert all(x == 0 for x in zero_half)
    sweep = TO.topic_sweep(feats, index.size, "target", (0, 1), ks=(2, 3), max_iter=3).collect()
    assert all(abs(r.log_perplexity + r.log_likelihood / r.weight) < 1e-9 for r in sweep)
    assert sorted((r.label, r.k) for r in sweep) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert all(r.log_likelihood < 0 and r.seconds > 0 for r in sweep)


def test_a_topic_matrix_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(TO, "MAX_TOPIC_ENTRIES", 11)
    df = spark.createDataFrame([(1, Vectors.sparse(4, [1], [1.0]))], ["id", "features"])
    with pytest.raises(ValueError):
        TO.fit_topics(df, "id", k=3)


def test_a_constant_model_has_not_learned(spark):
    """On separable rows the fitted models have, a model without weights and a constant answer haven't."""
    df = toy(spark)
    for kind, params in [("random_forest", {}), ("perceptron", {"maxIter": 200}), ("linear_svm", {}), ("logistic", {"regParam": 0.01})]:
        assert MO.learned(MO.train(df, kind, seed=7, **params), df).first().gap < 0.02, kind
    share = 0.0
    for kind in ("logistic", "linear_svm"):
        assert OP.descent(df, kind, [0.0] * 6, share, 0.01) > 0.3
    constant = MO.train(df.limit(0).unionByName(df.where("label = 1")).unionByName(df.where("label = 0").limit(1)), "random_forest", seed=7, numTrees=1, maxDepth=0)
    assert MO.learned(constant, df).first().gap > 0.2
    # strong regularisation keeps the weights at zero, which is the optimum then
    assert OP.descent(df, "logistic", [0.0] * 6, share, 100.0, 1.0) < 1e-6


def test_best_stump_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [([float(rnd.randint(0, 5)), float(rnd.randint(0, 2))], rnd.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame([(Vectors.dense(x), y) for x, y in rows], ["features", "label"])
    best = max(max(sum((x[f] > t) == (y == s) for x, y in rows) for s in (0, 1)) for f in (0, 1) for t in range(-1, 7))
    assert abs(OP.best_stump(df).first().accuracy - best / 60) < 1e-12


def test_tuning_scores_do_not_follow_the_layout(spark):
    df = toy(spark, 300)
    est = MO.estimator("logistic")
    tables = []
    for layout in (df.repartition(1), df.repartition(5, "label")):
        _, table = MO.tune(layout, est, MO.logistic_grid(est), 0.8, "logloss", key="id", parallelism=2)
        tables.append([(r.setting, round(r.score, 9), r.best) for r in table.orderBy("setting").collect()])
    assert tables[0] == tables[1] and len(tables[0]) == 12


def test_report_reads_accuracy_against_balance(spark):
    pred = spark.createDataFrame([(0.0, 0), (0.0, 0), (0.0, 1), (1.0, 1), (0.0, 0)],
                                 "prediction double, label int")
    r = ME.report(pred).first()
    assert (r.accuracy, r.rows, r.positives, r.majority_share) == (0.8, 5, 2, 0.6)


def test_a_large_model_has_its_topics_as_a_table(spark, monkeypatch):
    """Beyond MATRIX_ENTRIES nothing of the model's size is on the driver; mixtures, terms and classes are alike."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(TO, "MATRIX_ENTRIES", 3)
    rows = [(i, i % 2, Vectors.sparse(6, {2 * (i % 3): 4.0, 2 * (i % 3) + 1: 3.0})) for i in range(60)] + [(90, 0, Vectors.sparse(6, {}))]
    df = spark.createDataFrame(rows, ["id", "target", "features"])
    model = TO.topic_model(df, "id", k=3, max_iter=4)
    assert isinstance(model, TT.TopicTables) and TT.of_model(model) is model
    mixed = TO.topic_mixture(model, df)
    sums = {r.id: float(r.topicDistribution.toArray().sum()) for r in mixed.collect()}
    assert len(sums) == 61 and sums.pop(90) == 0.0 and all(abs(v - 1) < 1e-9 for v in sums.values())
    assert all(r.residual is None if r.id == 90 else r.residual < 2 * TT.CLOSE for r in TT.residual(mixed, "id", model).collect())
    vocabulary = spark.range(6).select(F.col("id").alias("index"), F.concat(F.lit("t"), "id").alias("term"))
    assert len(TO.topic_terms(model, vocabulary, 2).collect()) == 6
    models, out = TO.topics_by_class(df, "id", "target", (0, 1), k=3, max_iter=3)
    assert all(isinstance(m, TT.TopicTables) for m in models)
    for r in out.collect():
        assert len(r.topic) == 6 and all(x == 0 for x in (r.topic[3:] if r.target == 0 else r.topic[:3]))


def test_rows_of_a_long_fit_are_dealt_out_evenly(spark, monkeypatch):
    from textflow.operators import models as M

    rows = spark.range(2500).repartition(3).withColumn("x", F.col("id") * 2)
    assert M.spread(rows.limit(2000)).rdd.getNumPartitions() == 1  # not worth more
    monkeypatch.setattr(M, "LEAST_ROWS", 1000)
    parts = M.spread(rows.coalesce(1))
    assert parts.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) - min(sizes) <= 2 and parts.exceptAll(rows).count() == 0 and sum(sizes) == 2500
    monkeypatch.setattr(M, "MOST_ROWS", 100)
    assert M.spread(rows).rdd.getNumPartitions() == 25
    assert M.spread(rows.limit(0)).count() == 0
