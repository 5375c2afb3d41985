"""DataFrame -> DataFrame operators."""

from .filters import has_length, non_empty, of_class, without_value
from .metrics import accuracy, class_counts, evaluate, report, rmse
from .sampling import balanced_sample, hash_split, union_classes, with_split
from .vocab import (build_vocab, coverage, known_words, oov_by_count,
                    top_words, unknown_words)

__all__ = [
    "has_length", "non_empty", "of_class", "without_value", "accuracy", "class_counts",
    "evaluate", "report", "rmse", "balanced_sample", "hash_split", "union_classes", "with_split",
    "build_vocab", "coverage", "known_words", "oov_by_count", "top_words", "unknown_words",
]
