"""Array and vector expressions (Column -> Column), all JVM-side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def parse_vector(c, strict: bool = False, element_type: str = "float") -> Column:
    """Parse vector text such as ``[0.1, 0.2, 0.3]`` into an array.

    Lenient (default): split on commas and cast each piece; a piece that is
    not a number (the first and last, which carry the brackets) becomes
    NULL. Strict: remove the brackets first, so every piece parses.
    """
    x = _col(c)
    if strict:
        x = F.regexp_replace(x, "[\\[\\]]", "")
    return F.transform(F.split(x, ",", -1), lambda p: p.try_cast(element_type))


def take_items(c, start: int, stop: int) -> Column:
    """Items ``start .. stop-1`` (0-based) as a new array of fixed length
    ``stop - start``; positions past the end are NULL."""
    if stop <= start:
        raise ValueError("stop must be greater than start")
    # bound to a name, or the array would be made anew for every position
    of = lambda x: F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.get(x, i))
    return F.get(F.transform(F.array(_col(c)), of), F.lit(0))


def vector_items(c, dtype: str = "float32") -> Column:
    """ML vector -> array of float (``float32``) or double (``float64``)."""
    return vector_to_array(_col(c), dtype)


def to_vector(c) -> Column:
    """Array of numbers -> dense ML vector."""
    return array_to_vector(_col(c))


def pad_slots(c, slot, n_slots: int = 2, width: int | None = None) -> Column:
    """Place an array into slot ``slot`` of ``n_slots`` equal slots, zeros
    elsewhere. ``slot`` may be a column (e.g. the class label), so each row
    picks its own half; ``width`` defaults to the array's own length."""
    x = _col(c)
    s = F.lit(slot) if isinstance(slot, int) else _col(slot)
    w = F.size(x) if width is None else F.lit(width)
    zero = F.lit(0).cast("float")
    before = F.array_repeat(zero, (s * w).cast("int"))
    after = F.array_repeat(zero, ((F.lit(n_slots - 1) - s) * w).cast("int"))
    return F.concat(before, x.cast("array<float>"), after)


def vector_struct(c) -> Column:
    """An ML vector as its struct ``(type, size, indices, values)``."""
    return F.unwrap_udt(_col(c))


def struct_entries(s) -> Column:
    """Entries ``array<struct<index, value>>`` of a vector struct (see
    ``vector_struct``): stored entries of a sparse vector, every position of
    a dense one."""
    s = _col(s)
    idx = F.when(s["type"] == 0, s["indices"]).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(s["values"]) - 1, F.lit(0))))
    return F.filter(
        F.arrays_zip(idx.alias("index"), s["values"].alias("value")),
        lambda e: e["index"].isNotNull() & e["value"].isNotNull(),
    )


def vector_size(c) -> Column:
    """Width of an ML vector, without making a sparse one dense."""
    s = vector_struct(c)
    return F.when(s["type"] == 0, s["size"]).otherwise(F.size(s["values"]))


def vector_entries(c) -> Column:
    """Non-zero entries of an ML vector as ``array<struct<index int, value double>>``.

    Built from the vector's struct form, so it stays JVM-side and never
    densifies a sparse vector. Inside a generator (``explode``) project
    ``vector_struct`` first and apply ``struct_entries`` to that column, so
    the struct is built once per row.
    """
    return struct_entries(vector_struct(c))
