"""Physical-plan checks: pruned and pushed-down scans, no Python
evaluation anywhere, exchanges only where a key changes."""

import pytest

import __spark_entry__ as E
from conftest import SF001

# keys whose DataFrame is built without fitting a model
PLAIN = ["scan_corpus", "rename_positional", "as_labelled", "non_empty", "of_class", "has_length",
         "without_value", "build_vocab", "lexicon_words", "known_words", "unknown_words", "coverage",
         "coverage_by_step", "oov_by_count", "top_words", "accuracy", "rmse", "union_classes",
         "hash_split", "trim_text", "ascii_only", "clean_punct_a", "clean_punct_b", "mask_numbers",
         "fix_misspellings", "clean_corpus", "clean_corpus_main", "clean_corpus_notebook",
         "clean_corpus_explore", "to_label", "parse_vector", "parse_vector_strict", "take_items",
         "pad_slots", "to_vector", "feature_arrays", "tokenize", "remove_stop_words", "term_counts", "idf",
         "tf_idf", "word_vector_vocab", "explore_vector_vocab"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PLAIN)
def test_no_python_evaluation(spark, key):
    p = plan(E.queries()[key](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_corpus_scan_is_pruned_and_filtered(spark):
    df = E.queries()["of_class"](spark, SF001)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in text
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in text
    assert "n_chars" not in text and "lang" not in text


def test_cleaning_is_one_projection(spark):
    p = plan(E.queries()["clean_corpus"](spark, SF001))
    assert p.count("Exchange") <= 1      # a broadcast


def test_lexicon_join_reuses_the_aggregate_partitioning(spark):
    # with broadcasts off, the anti join must be a sort-merge join whose two
    # inputs are the hash exchanges of the two aggregates (none added for it)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from textflow.operators import vocab as VO
        from textflow.sources import tables as TB
        vocab = VO.build_vocab(TB.table(spark, SF001, "documents", ["doc_id", "text"]), "text")
        p = plan(VO.unknown_words(vocab, TB.lexicon(spark, SF001)))
        assert "SortMergeJoin" in p
        assert p.count("Exchange hashpartitioning(word") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_term_rows_hold_no_vocabulary_on_the_driver(spark):
    p = plan(E.queries()["tf_idf"](spark, SF001))
    assert "partial_count" in p and "LocalTableScan" not in p and "ExistingRDD" not in p


def test_vocabulary_combines_map_side(spark):
    p = plan(E.queries()["build_vocab"](spark, SF001))
    assert "partial_count" in p            # hot words collapse before the shuffle


def test_split_is_map_only(spark):
    from textflow.operators import sampling as SA
    df = spark.range(100).selectExpr("cast(id as string) AS qid")
    assert "Exchange" not in plan(SA.with_split(df, (0.6, 0.4), "qid", 24))


def test_coverage_by_step_scans_the_text_once(spark):
    p = plan(E.queries()["coverage_by_step"](spark, SF001))
    assert p.count("documents.parquet") == 1 and p.count("benchmark.parquet") == 1
