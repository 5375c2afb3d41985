"""Pipelines composed from the operators."""

from .cleaning import PRESETS, clean_corpus, coverage_by_step, vocab_by_step
from .classifier import (ClassifierRun, classify_features, load_feature_arrays,
                         question_classifier, question_features, tfidf_features)
from .export import class_topic_features, export_class_topic_features, topic_tuning

__all__ = ["PRESETS", "clean_corpus", "coverage_by_step", "vocab_by_step", "ClassifierRun",
           "classify_features", "load_feature_arrays", "question_classifier", "question_features",
           "tfidf_features", "class_topic_features", "export_class_topic_features", "topic_tuning"]
