"""Vocabulary and lexicon coverage as distributed aggregates and joins.

``build_vocab`` is a two-phase hash aggregate (map-side partial counts, so a
word holding a third of all occurrences costs one row per task before the
shuffle). The lexicon joins run on the ``word`` key, which both sides are
already hash-partitioned on after their aggregations, so the join adds no
exchange of its own; AQE turns it into a broadcast join at run time when
one side is measured under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_of


def build_vocab(df: DataFrame, col: str = "question_text", words=words_of) -> DataFrame:
    """Word counts ``(word string, n bigint)`` over whitespace-split text.
    NULL text contributes nothing."""
    return (df.select(F.explode(words(col)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def known_words(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Vocabulary entries found in the lexicon (left semi join)."""
    return vocab.join(lexicon.select("word"), "word", "left_semi")


def unknown_words(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Vocabulary entries missing from the lexicon (left anti join)."""
    return vocab.join(lexicon.select("word"), "word", "left_anti")


def coverage(vocab: DataFrame, lexicon: DataFrame, digits: int | None = 6) -> DataFrame:
    """One row: share of distinct words known (``vocab_ratio``) and share of
    all occurrences known (``text_ratio``). The lexicon must hold each word
    once (as ``read_lexicon`` / ``lexicon_from_text`` give it)."""
    marked = vocab.join(lexicon.select("word", F.lit(1).alias("known")), "word", "left")
    k = F.coalesce(F.col("known"), F.lit(0))
    out = marked.agg(
        (F.sum(k) / F.count(F.lit(1))).alias("vocab_ratio"),
        (F.sum(k * F.col("n")) / F.sum("n")).alias("text_ratio"),
    )
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) for c in out.columns])
    return out


def oov_by_count(vocab: DataFrame, lexicon: DataFrame, limit: int | None = None) -> DataFrame:
    """Unknown words, most frequent first; ties by word. With ``limit`` this
    is a top-k (``TakeOrderedAndProject``), else a range-partitioned sort."""
    out = unknown_words(vocab, lexicon).orderBy(F.desc("n"), F.asc("word"))
    return out if limit is None else out.limit(limit)


def top_words(vocab: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent words (ties by word)."""
    return vocab.orderBy(F.desc("n"), F.asc("word")).limit(n)
