"""Per-class topic features and their export, then the classifiers that
read such an export back.

``class_topic_features`` is the notebook flow: word vectors and TF-IDF for
every question, one LDA per class, each class's mixture placed in its own
half of a ``2k`` array, classes stacked. ``export_class_topic_features``
writes the table with every task writing its own part (Parquet, or CSV
with vectors as ``[a, b, ...]`` text for readers that expect text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import word_vectors
from ..operators.sampling import balanced_sample
from ..operators.topics import topic_sweep, topics_by_class
from ..session import lineage_cut
from ..sources.corpus import write_features
from .classifier import question_features, tfidf_features


def class_topic_features(corpus: DataFrame, preset: str = "notebook", k: int = 20,
                         max_iter: int = 100, classes=(0, 1), key: str = "qid",
                         target: str = "target", w2v_size: int = 100, min_count: int = 2,
                         min_df: float = 1.0, seed: int = 24) -> DataFrame:
    """``key, wordvectors, topic (array of 2k floats), target``.

    The non-zero half of ``topic`` is chosen by the true class, so the
    column reveals the label; it reproduces the export, it is not a fair
    feature for a classifier.
    """
    tokens = lineage_cut(question_features(corpus, preset, key, target=target))
    w2v, _ = word_vectors(tokens, key, "filtered", "wordvectors", size=w2v_size, min_count=min_count,
                          seed=seed)
    _, feats = tfidf_features(tokens, "filtered", min_df)
    feats = w2v.transform(feats)
    _, out = topics_by_class(feats, key, target, classes, k=k, max_iter=max_iter, seed=seed,
                             output_col="topic")
    return out.select(key, "wordvectors", "topic", F.col(target).alias("target"))


def export_class_topic_features(corpus: DataFrame, path: str, fmt: str = "parquet",
                                text_vectors: bool = False, **kw) -> DataFrame:
    """Compute ``class_topic_features`` and write it; returns the table
    read back from ``path``."""
    table = class_topic_features(corpus, **kw)
    write_features(table, path, fmt=fmt, text_vectors=text_vectors)
    spark = corpus.sparkSession
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def topic_tuning(corpus: DataFrame, n: int = 10000, ks=range(7, 20), max_iter: int = 50,
                 classes=(1, 0), key: str = "qid", target: str = "target",
                 min_df: float = 1.0, seed: int = 24) -> DataFrame:
    """The topic-count sweep as a whole: ``n`` questions per class (hash
    order), the ``tuning`` cleaning chain, tokens without stop words, TF-IDF
    fitted on the sample, then one topic model per class and ``k``, all fitted together and scored by
    log-likelihood and log-perplexity (``topic_sweep``).

    Only the sample pass touches the whole corpus (one scan with a partial
    aggregate); every fit and score works on at most ``n`` rows per class,
    so the sweep's cost does not grow with the corpus."""
    sample = balanced_sample(corpus, target, n, key)
    tokens = question_features(sample, "tuning", key, target=target)
    index, feats = tfidf_features(tokens, "filtered", min_df)
    return topic_sweep(feats, index.size, target, sorted(classes), ks, max_iter, seed)
