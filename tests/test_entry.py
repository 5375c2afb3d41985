"""Contract file: every query has an oracle or is listed as model-only."""

import __spark_entry__ as E
from conftest import SF001


def test_every_query_has_an_oracle():
    added, _ = E._llm_queries()
    assert set(E.queries()) - set(added) == set(E.oracle_sql()) - set(added)


def test_missing_folders_leave_the_other_queries(monkeypatch):
    import sys
    with_them = set(E.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(E.queries()) == with_them - set(E._llm_queries()[0]) - {k for k in with_them if k == "pipeline" or k.startswith("op")
                                                                      and k[2:3].isdigit()}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["qid", "prediction", "label"]
    rows = df.collect()
    assert rows and all(r.prediction in (0.0, 1.0) for r in rows)


def test_flagship_pipeline_small(spark):
    from textflow.plans.classifier import question_classifier
    from textflow.sources.tables import corpus
    run = question_classifier(corpus(spark, SF001), k=3, lda_iter=3, w2v_size=10, min_df=2.0)
    rows = run.predictions.collect()
    assert rows and all(r.prediction in (0.0, 1.0) for r in rows)
    assert run.features.schema["features"].metadata["ml_attr"]["num_attrs"] == 10 + 3


def test_classifier_run_report(spark):
    from textflow.plans.classifier import classify_features
    from textflow.sources.tables import feature_text
    run = classify_features(feature_text(spark, SF001), "logistic")
    r = run.report().first()
    assert r.rows == run.predictions.count() and 0.5 <= r.majority_share <= 1.0
