"""The corpus pipeline: five stages over ``documents``.

1. language_id: documents whose language can't be told are rejected and go.
2. line_dedup: aligned blocks of lines shared with an earlier document are
   deleted; a document that loses all its text goes.
3. simhash: of each group of near-duplicates the document with the smallest id stays.
4. decontaminate: a document with a benchmark window goes.
5. byte_bpe: the rest is encoded and decoded; per document the number of
   tokens and digests of ids and bytes.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``. Empty tables pass through as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.llm import decontaminate, language_id, line_dedup, registry, simhash
from textflow.llm.shared import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that aren't held out; keeps what isn't rejected."""
    model = language_id.fit(docs.where(~registry.held_out()))
    found = docs.select(*COLUMNS, language_id.predict(F.col("text"), model).alias("__language"))
    return found.where("not __language.rejected").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text; a null or empty text without a deletion stays as it is."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    done = done.where("n_removed = 0 or text rlike '\\\\S'")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.with_hits(docs.select(*COLUMNS), items, out="__hits")
    return marked.where(F.size("__hits.words") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return registry.token_digests(docs.select("doc_id", "text"), *registry.vocabulary(spark))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash", dedup_near),
          ("decontaminate", remove_benchmark), ("byte_bpe", encode)]

#: No SQL: a fitted classifier, patience diff, SimHash and BPE are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
