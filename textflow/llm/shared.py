"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import lineage_cut as cut  # noqa: F401
from ..session import release as drop  # noqa: F401
from ..session import scratch_dir  # noqa: F401

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither a digit nor a letter becomes a space.
ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; null stays None."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def gathered(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one partition and next to each other, for ``groups``."""
    return df.repartition(key).sortWithinPartitions(key)


def groups(batches, key: str):
    """The groups of ``gathered`` rows, one table after the other. ``key`` is
    a non-null integer column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            if held and held[0].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
