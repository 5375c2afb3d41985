"""Whole pipelines: the question classifier and the feature-file
classifiers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import parse_vector, take_items, to_vector, vector_items
from ..functions.text import to_label
from ..operators.features import W2V_PARTITIONS, assemble, remove_stop_words, tokenize, word_vectors
from ..operators.filters import has_length, without_value
from ..operators.metrics import report
from ..operators.models import predict, train
from ..operators.sampling import with_split
from ..operators.term_index import TermIndex, fit_term_index, numbered, term_vectors
from ..operators.topics import LDA_PARTITIONS, topic_mixture, topic_model
from ..session import lineage_cut
from ..sources.corpus import as_labelled
from .cleaning import clean_corpus


class _Clock:
    def __init__(self, sink):
        self.sink = sink

    def __call__(self, name, fn):
        t = time.perf_counter()
        out = fn()
        if self.sink is not None:
            self.sink[name] = time.perf_counter() - t
        return out


@dataclass
class ClassifierRun:
    predictions: DataFrame           # key, prediction, label
    models: dict = field(default_factory=dict)
    features: DataFrame | None = None

    def report(self) -> DataFrame:
        """Accuracy on the held-out part next to its class balance."""
        return report(self.predictions)


def question_features(corpus: DataFrame, preset: str = "main", key: str = "qid",
                      text: str = "question_text", target: str = "target") -> DataFrame:
    """Clean, tokenise and drop stop words: ``key, filtered, target``."""
    clean = clean_corpus(corpus, preset, text)
    tokens = remove_stop_words(tokenize(clean, text, "words"), "words", "filtered")
    return tokens.select(key, "filtered", target)


def tfidf_features(tokens: DataFrame, input_col: str = "filtered", min_df: float = 1.0) -> tuple[TermIndex, DataFrame]:
    """Number the terms of a token table and add the vectors of counts and of TF-IDF
    weights (``rawFeatures``, ``features``). The tokens are written once, so that
    the cleaning isn't run again. Returns ``(index, table)``."""
    rows = numbered(tokens)
    index = fit_term_index(rows, input_col, min_df)
    return index, term_vectors(rows, index, input_col).drop("__row")


def question_classifier(corpus: DataFrame, preset: str = "main", key: str = "qid",
                        target: str = "target", w2v_size: int = 100, min_count: int = 2,
                        w2v_partitions: int = W2V_PARTITIONS, min_df: float = 1.0, lda_partitions: int = LDA_PARTITIONS,
                        k: int = 8, lda_iter: int = 100, kind: str = "random_forest",
                        weights=(0.6, 0.4), seed: int = 24, fit_on: str = "all",
                        drop_value: float | None = 9, timings: dict | None = None,
                        **model_params) -> ClassifierRun:
    """Clean -> tokens -> word vectors + TF-IDF -> LDA mixture -> assembled
    features -> hash split -> classifier -> predictions on the test part.

    ``fit_on="all"`` fits the feature models on every row (as the original
    pipeline does, so test rows shape the features); ``"train"`` fits them
    on the training part only. The mixture filters keep the original
    semantics: exactly ``k`` items and no item equal to ``drop_value``.
    ``timings`` (a dict) receives the seconds of each step.
    """
    clock = _Clock(timings)
    tokens = with_split(question_features(corpus, preset, key, target=target), weights, key, seed, "part")
    tokens = clock("tokens", lambda: numbered(tokens))      # read by four fits
    fit_rows = tokens if fit_on == "all" else tokens.where(F.col("part") == 0)

    w2v_model, _ = clock("word2vec", lambda: word_vectors(
        fit_rows, key, "filtered", "wordvectors", size=w2v_size, min_count=min_count, seed=seed,
        partitions=w2v_partitions))
    index = clock("term_index", lambda: fit_term_index(fit_rows, "filtered", min_df))
    counted = clock("term_vectors", lambda: term_vectors(tokens, index, "filtered", counts="rawFeatures"))
    lda_model = clock("lda", lambda: topic_model(counted if fit_on == "all" else counted.where(F.col("part") == 0), key, k, lda_iter, seed,
                                                partitions=lda_partitions))

    feats = topic_mixture(lda_model, w2v_model.transform(counted))
    feats = feats.select(key, "part", "wordvectors",
                         vector_items("topicDistribution").alias("topics"),
                         to_label(F.col(target)).alias("label"))
    feats = has_length(feats, "topics", k)
    if drop_value is not None:
        feats = without_value(feats, "topics", drop_value)
    feats = feats.withColumn("topics", to_vector("topics"))
    feats = assemble(feats, ["wordvectors", "topics"], "features").select(key, "part", "label", "features")
    feats = clock("features", lambda: lineage_cut(feats))   # read by every tree level and the scoring

    model = clock("classifier", lambda: train(feats.where(F.col("part") == 0), kind, "features", "label",
                                              seed, **model_params))
    pred = predict(model, feats.where(F.col("part") == 1)).select(key, "prediction", "label")
    return ClassifierRun(pred, {"word2vec": w2v_model, "index": index, "lda": lda_model,
                                 "classifier": model}, feats)


def load_feature_arrays(df: DataFrame, vector_col: str = "topics", label_col: str = "target",
                        start: int = 1, stop: int = 19, drop_value: float | None = 9,
                        strict: bool = False, keep=()) -> DataFrame:
    """Feature text -> ``label, features`` vectors: parse (lenient: bracket
    pieces become NULL), take items ``start..stop-1``, keep rows of exactly
    that length, drop rows containing ``drop_value`` (which also drops rows
    with a NULL item), make a dense vector."""
    d = df.select(*keep, F.col(label_col).alias("label"), F.col(vector_col).alias("features"))
    d = d.withColumn("features", take_items(parse_vector("features", strict), start, stop))
    d = has_length(d, "features", stop - start)
    if drop_value is not None:
        d = without_value(d, "features", drop_value)
    return d.withColumn("features", to_vector("features"))


def classify_features(df: DataFrame, kind: str = "random_forest", key: str = "vec_id",
                      weights=(0.7, 0.3), seed: int = 24, vector_col: str = "topics",
                      label_col: str = "target", drop_value: float | None = 9,
                      start: int = 1, stop: int = 19, strict: bool = False,
                      **model_params) -> ClassifierRun:
    """The feature-file classifiers: arrays -> split -> fit -> predictions
    on the held-out part (label kept in the row)."""
    data = load_feature_arrays(df, vector_col, label_col, start, stop, drop_value=drop_value,
                               strict=strict, keep=(key,))
    data = lineage_cut(with_split(data, weights, key, seed, "part"))
    model = train(data.where(F.col("part") == 0), kind, "features", "label", seed, **model_params)
    pred = predict(model, data.where(F.col("part") == 1)).select(key, "prediction", "label")
    return ClassifierRun(pred, {"classifier": model}, data)


__all__ = ["ClassifierRun", "question_features", "tfidf_features", "question_classifier", "load_feature_arrays",
           "classify_features", "as_labelled"]
