"""Row filters (DataFrame -> DataFrame). Plain predicates, so Catalyst
pushes them towards the scan and merges them with neighbouring filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def non_empty(df: DataFrame, col: str = "question_text") -> DataFrame:
    """Keep rows whose text is not the empty string. NULL text is dropped
    as well (the comparison is NULL); a lone space is kept."""
    return df.where(F.col(col) != "")


def of_class(df: DataFrame, value, label: str = "target") -> DataFrame:
    """Keep one class."""
    return df.where(F.col(label) == F.lit(value))


def has_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep rows whose array has exactly ``n`` items."""
    return df.where(F.size(col) == n)


def without_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows whose array contains ``value``.

    Three-valued logic is kept on purpose: for an array holding a NULL item
    and no match, ``array_contains`` is NULL and the row is dropped too, as
    is a NULL array. So this also removes arrays with unparsed (NULL)
    items. The value is cast to the array's element type.
    """
    dtype = df.schema[col].dataType
    elem = dtype.elementType if isinstance(dtype, T.ArrayType) else T.FloatType()
    return df.where(F.array_contains(F.col(col), F.lit(value).cast(elem)) == F.lit(False))
