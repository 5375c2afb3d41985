"""Mapping of the shared test tables onto the fixtures the operators expect.

* labelled corpus = ``documents`` joined with ``labels`` on ``doc_id``
  (``qid = doc_id`` as text, ``question_text = text``, ``target = toxic``);
* unlabelled text = ``documents``;
* lexicon = the distinct whitespace words of ``benchmark.text``;
* feature text = all items of ``embeddings.embedding`` as ``floor(x * 100)``
  integers in brackets, class ``label % 2``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import lexicon_from_text


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Scan one table (only ``columns`` when given). How a scan is split is
    left to Spark's file settings."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid string, question_text string, target int``.

    The join lets the planner choose: ``labels`` is broadcast when its
    file-size estimate is under the broadcast threshold, else both sides
    are shuffled on ``doc_id``; only the three needed columns are read.
    """
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("qid"),
        F.col("text").alias("question_text"),
        F.col("toxic").cast("int").alias("target"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_from_text(table(spark, sf_dir, "benchmark"), "text")


def feature_text(spark: SparkSession, sf_dir: str, vector_col: str = "topics") -> DataFrame:
    """``vec_id bigint, target int, <vector_col> string`` such as
    ``[12, -3, ...]``; the id is kept so results can be checked row by row."""
    emb = table(spark, sf_dir, "embeddings")
    items = F.transform("embedding",
                        lambda x: F.floor(x.cast("double") * 100).cast("int").cast("string"))
    return emb.select(
        "vec_id",
        (F.col("label") % 2).cast("int").alias("target"),
        F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias(vector_col),
    )
