"""Topic models as tables: special functions, Spark's bound and mixtures, fits against Spark's."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textflow.functions import special
from textflow.operators import topic_tables as TT
from textflow.operators import topics as TO


def test_special_functions():
    x = np.array([1e-3, 0.05, 0.5, 1.0, 2.5, 9.0, 1e3, 1e6])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5
    y = np.array([0.5, 1.0, 2.5, 9.0, 50.0])
    assert np.allclose(special.digamma(y), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in y], atol=1e-8)
    assert np.allclose(special.digamma(y + 1), special.digamma(y) + 1 / y, atol=1e-12)
    assert np.allclose(special.trigamma(y + 1), special.trigamma(y) - 1 / y ** 2, atol=1e-12)
    assert abs(special.digamma(1.0) + 0.5772156649015329) < 1e-12 and abs(special.trigamma(1.0) - math.pi ** 2 / 6) < 1e-11


WIDTH = 60


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of three kinds, each with its own third of the terms, of two classes; one is empty."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        own = range(20 * (i % 3), 20 * (i % 3) + 20)
        held = {}
        for _ in range(rng.randint(20, 60)):
            t = rng.choice(own) if rng.random() < 0.9 else rng.randrange(WIDTH)
            held[t] = held.get(t, 0) + rng.choice([1.0, 0.5])
        rows.append((i, i % 2, Vectors.sparse(WIDTH, held)))
    rows.append((999, 0, Vectors.sparse(WIDTH, {})))
    return spark.createDataFrame(rows, ["id", "target", "features"]).cache()


@pytest.fixture(scope="module")
def model(docs):
    return TO.fit_topics(docs, "id", k=3, max_iter=10, subsamplingRate=1.0, learningOffset=1.0)


def test_bound_is_sparks(docs, model):
    tables = TT.of_model(model)
    got = TT.likelihood(TT.term_rows(docs, "features"), tables).first()
    want = model.logLikelihood(docs)
    assert abs(got.log_likelihood - want) < 1e-4 * abs(want)
    assert abs(-got.log_likelihood / got.weight - model.logPerplexity(docs)) < 1e-4
    matrix = model.topicsMatrix().toArray()
    assert np.allclose(np.array([r.w for r in tables.rows.orderBy("index").collect()]), matrix)


def test_mixtures_are_sparks_and_a_shuffled_one_is_found(spark, docs, model):
    tables = TT.of_model(model)
    rows = TT.term_rows(docs, "features")
    assert rows.count() == 240
    mixed = TO.topic_mixture(model, docs)
    own = sorted(round(max(r.mixture), 2) for r in TT.mixture(rows, tables).collect())
    spark_own = sorted(round(float(max(r.topicDistribution)), 2) for r in mixed.where("id <> 999").collect())
    assert np.allclose(own, spark_own, atol=0.02)
    moved = {r.id: r.residual for r in TT.residual(mixed, "id", tables).collect()}
    assert moved.pop(999) is None and max(moved.values()) < 2 * TT.CLOSE
    # each document with the mixture of the next
    other = mixed.select((F.col("id") - 1).alias("id"), F.col("topicDistribution").alias("d"))
    shuffled = mixed.drop("topicDistribution").join(other, "id").withColumnRenamed("d", "topicDistribution")
    moved = [r.residual for r in TT.residual(shuffled, "id", tables).collect()]
    assert sum(m > 2 * TT.CLOSE for m in moved if m is not None) > 200


def test_fits_reach_sparks_likelihood(docs, model):
    rows = TT.term_rows(docs, "features")
    tables = TT.fit_topic_tables(docs, WIDTH, (3,), max_iter=10, subsampling=1.0, offset=1.0, docs=rows)
    got, want = TT.likelihood(rows, tables).first().log_likelihood, model.logLikelihood(docs)
    assert abs(got - want) < 0.01 * abs(want)
    w = np.array([r.w for r in tables.rows.orderBy("index").collect()])
    assert w.shape == (WIDTH, 3) and np.allclose(w.sum(axis=0), tables.sums[0], rtol=1e-9)
    # each topic is one third of the terms
    tops = [set(np.argsort(-w[:, t])[:10] // 20) for t in range(3)]
    assert sorted(t.pop() for t in tops if len(t) == 1) == [0, 1, 2]
    index = docs.sparkSession.createDataFrame([(i, f"t{i}") for i in range(WIDTH)], "index bigint, term string")
    terms = TT.topic_terms(tables, index, 4).collect()
    assert len(terms) == 12 and {(r.topic, r.rank) for r in terms} == {(t, r) for t in range(3) for r in range(4)}
    share = {(r.topic, r.term): r.weight for r in terms}
    assert all(abs(v - w[int(t[1:]), k] / w[:, k].sum()) < 1e-9 for (k, t), v in share.items())


def test_models_fitted_together_are_those_fitted_alone(docs):
    """Groups don't mix, and repeat in any layout."""
    both = TT.fit_topic_tables(docs, WIDTH, (2,), "target", max_iter=4, subsampling=1.0)
    again = TT.fit_topic_tables(docs, WIDTH, (2,), "target", max_iter=4, subsampling=1.0)
    alone = TT.fit_topic_tables(docs.where("target = 1"), WIDTH, (2,), "target", max_iter=4, subsampling=1.0)
    of = lambda t, g: np.array([r.w for r in t.rows.where(F.col("grp") == g).orderBy("index").collect()])
    assert np.allclose(of(both, 1), of(alone, 1), rtol=1e-6) and np.allclose(of(both, 0), of(again, 0), rtol=1e-9)
    assert not np.allclose(of(both, 0), of(both, 1))
    scored = TT.likelihood(TT.term_rows(docs, "features", "target"), TT.fit_topic_tables(docs, WIDTH, (2, 3), "target", max_iter=4)).collect()
    assert sorted((r.grp, r.k) for r in scored) == [(0, 2), (0, 3), (1, 2), (1, 3)]


def test_additions_are_folded_and_batches_shuffled_alike(docs, monkeypatch):
    want = TT.fit_topic_tables(docs, WIDTH, (2,), max_iter=7)
    monkeypatch.setattr(TT, "FOLD", 3)
    monkeypatch.setattr(TT, "BROADCAST_TERMS", 0)
    got = TT.fit_topic_tables(docs, WIDTH, (2,), max_iter=7)
    of = lambda t: np.array([r.w for r in t.rows.orderBy("index").collect()])
    assert np.allclose(of(got), of(want), rtol=1e-9) and np.allclose(got.sums[0], want.sums[0])


def test_no_documents(docs):
    none = docs.limit(0)
    tables = TT.fit_topic_tables(none, WIDTH, (2,), max_iter=2)
    assert TT.likelihood(TT.term_rows(none, "features"), tables).collect() == []


def test_a_step_reads_the_rows_of_its_batch_only(docs, monkeypatch):
    """Blocks of few values give the same model, and rows asked for without a weight start as drawn."""
    want = TT.fit_topic_tables(docs, WIDTH, (2, 3), "target", max_iter=4, subsampling=0.5)
    monkeypatch.setattr(TT, "BLOCK_VALUES", 2000)
    assert TT._block_count(240 * 20, 5) == 12
    got = TT.fit_topic_tables(docs, WIDTH, (2, 3), "target", max_iter=4, subsampling=0.5)
    of = lambda t: np.array([r.w for r in t.rows.orderBy("grp", "index").collect()])
    assert of(got).shape == (2 * WIDTH, 5) and np.allclose(of(got), of(want), rtol=1e-9)
    drawn = TT._drawn(np.zeros(20000, np.int32), np.arange(20000), 24, np.array([0.5, 0.5])) + 0.5
    assert abs(drawn.mean() - 1) < 0.005 and abs(drawn.std() - 0.1) < 0.005 and drawn.min() > 0


def test_steps_leave_nothing_behind(spark, docs, monkeypatch):
    """Rows are deleted when later steps have them, and the model's table alone is left."""
    from textflow.session import release

    monkeypatch.setattr(TT, "FOLD", 2)
    gone = []
    monkeypatch.setattr(TT, "release", lambda df: (gone.extend({f.rsplit("/", 2)[1] for f in df.inputFiles()}), release(df)))
    tables = TT.fit_topic_tables(docs, WIDTH, (2,), max_iter=4, subsampling=1.0)
    assert {"batches", *(f"step-{t}" for t in range(4))} <= set(gone)
    assert tables.rows.count() == WIDTH and np.isclose(sum(r.w[0] for r in tables.rows.collect()), tables.sums[0][0])


def test_documents_inferred_together_are_those_inferred_alone():
    """A document's weights depend neither on the others of a chunk nor on what fills it up."""
    rng = np.random.default_rng(3)
    alpha = np.array([0.2, 0.5, 0.1])
    lengths = [1, 4, 9, 9, 2, 7, 9, 3]
    x, beta = np.zeros((8, 9)), rng.random((8, 9, 3))
    for d, n in enumerate(lengths):
        x[d, :n] = rng.integers(1, 5, n) * 1.5
    got = TT.infer(x, beta, alpha)
    for d, n in enumerate(lengths):
        gamma = np.ones(3)
        while True:
            theta = np.exp(special.digamma(gamma) - special.digamma(gamma.sum()))
            new = theta * ((x[d, :n] / (beta[d, :n] @ theta)) @ beta[d, :n]) + alpha
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved <= TT.CLOSE:
                break
        assert np.allclose(got[d], gamma, rtol=1e-9)


def test_lists_that_go_to_python_are_not_null(spark, docs):
    """Null lists cost Spark the square of a batch's rows."""
    weights = spark.createDataFrame([(0, 7, bytearray(8), 0)], "grp int, index bigint, w binary, block int")
    rows = TT.term_rows(docs, "features").withColumn("block", F.lit(0))
    for table in (TT._in_blocks(rows, weights, 1), TT._by_term(weights.drop("w").withColumn("blocks", F.lit(bytes(4))), weights)):
        lists = [f.name for f in table.schema if f.dataType.typeName() in ("array", "binary")]
        assert len(lists) >= 2 and not table.where(" or ".join(f"{c} is null" for c in lists)).count()


def test_steps_of_terms_are_planned(spark, docs, monkeypatch):
    """Each term's steps with their blocks and the next step, counted some documents at a time."""
    monkeypatch.setattr(TT, "USES", 50)
    rng = random.Random(2)
    rows = [(rng.randrange(2), sorted(rng.sample(range(30), rng.randint(1, 12))), rng.randrange(3), sorted(rng.sample(range(5), rng.randint(1, 5)))) for _ in range(60)]
    want: dict = {}
    for g, i, block, steps in rows:
        for t in i:
            for s in steps:
                want.setdefault((g, t), {}).setdefault(s, set()).add(block)
    uses = spark.createDataFrame(rows, "grp int, i array<bigint>, block int, steps array<int>").mapInArrow(TT._uses(3, 5), "grp int, index bigint, codes binary")
    plan = uses.repartition(2, "grp", "index").sortWithinPartitions("grp", "index").mapInArrow(TT._plan(3, 5), "grp int, index bigint, step int, next int, blocks binary").collect()
    got: dict = {}
    for r in plan:
        got.setdefault((r.grp, r["index"]), {})[r.step] = (r.next, set(np.frombuffer(r.blocks, np.int32).tolist()))
    after = lambda of, s: min((x for x in of if x > s), default=5)
    assert got == {k: {s: (after(of, s), b) for s, b in of.items()} for k, of in want.items()} and len(plan) == sum(map(len, want.values()))


def test_classes_share_the_steps_of_a_fit(docs, monkeypatch):
    """One fit for all classes, and each document has the mixture of its own class's model."""
    monkeypatch.setattr(TO, "MATRIX_ENTRIES", 0)
    calls = []
    monkeypatch.setattr(TO, "fit_topic_tables", lambda *a, **b: calls.append(1) or TT.fit_topic_tables(*a, **b))
    models, out = TO.topics_by_class(docs, "id", "target", (1, 0), k=2, max_iter=3)
    assert len(calls) == 1 and [sorted(m.sums) for m in models] == [[0], [0]]
    rows = out.collect()
    assert len(rows) == 241
    for m, slot, cls in zip(models, (0, 1), (1, 0), strict=True):
        assert m.rows.count() == WIDTH
        for r in (r for r in rows if r.target == cls and r.id != 999):
            assert abs(sum(r.topic[2 * slot:2 * slot + 2]) - 1) < 1e-6 and not any(r.topic[2 - 2 * slot:4 - 2 * slot])
