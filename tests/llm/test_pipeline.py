"""The stages one by one on a small table, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textflow.llm import registry

SF001 = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def test_stages_and_their_order():
    assert list(STAGES) == ["language_id", "line_dedup", "simhash", "decontaminate", "byte_bpe"]


def test_language_stage_keeps_documents_and_drops_what_has_no_language(spark, docs):
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "123 456", "en", "s", 7), (-3, "", "en", "s", 0)], docs.schema)
    out = STAGES["language_id"](spark, docs.unionByName(odd), SF001)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_line_stage_empties_copies(spark, docs):
    first = docs.where(F.size(F.split("text", " ")) > 50).orderBy("doc_id").limit(1)
    out = STAGES["line_dedup"](spark, docs.unionByName(first.withColumn("doc_id", F.lit(10**9).cast("bigint"))), SF001)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and 10**9 not in ids and first.first().doc_id in ids
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5], docs.schema)
    assert STAGES["line_dedup"](spark, nulls, SF001).count() == 2


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    groups = {r.component_id for r in registry.op6_simhash(spark, SF001).collect()}
    out = STAGES["simhash"](spark, docs, SF001)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(groups)


def test_benchmark_stage_drops_what_op9_marks(spark, docs):
    bad = {r.doc_id for r in registry.op9_decontaminate(spark, SF001).collect() if r.contaminated}
    out = STAGES["decontaminate"](spark, docs, SF001)
    assert bad and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_run_equals_its_stages(spark, docs):
    table = docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF001)
        table = spark.createDataFrame(table.collect(), table.schema)
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect())) != []


def test_empty_table_passes(spark, docs):
    table = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = spark.createDataFrame([], stage(spark, table, SF001).schema)
    assert table.columns[0] == "doc_id"
