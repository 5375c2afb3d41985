"""Unions, balanced samples and reproducible splits.

Both the sample and the split order rows by an MD5 hash of the row key, so
results do not depend on partitioning, task order or the number of
executors (``randomSplit`` does: the same data and seed split differently
under two layouts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the MD5 used to order rows in a sample (64 bits).
_ORDER_HEX = 16
# Classes of a balanced sample, at most.
MAX_CLASSES = 1000
# Hex digits of the MD5 used for splits (32 bits).
_SPLIT_HEX = 8


def union_classes(*parts: DataFrame, by_name: bool = True) -> DataFrame:
    """Stack per-class tables, duplicates kept: by column name (default),
    or by position (``by_name=False``, plain ``union``)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p) if by_name else out.union(p)
    return out


def order_hash(key: str, seed=None) -> Column:
    """First 16 hex digits of ``md5(key)`` (or of ``key:seed``)."""
    s = F.col(key).cast("string")
    if seed is not None:
        s = F.concat(s, F.lit(f":{seed}"))
    return F.substring(F.md5(s), 1, _ORDER_HEX)


def balanced_sample(df: DataFrame, label: str = "target", n: int = 10000,
                    key: str = "qid", sort: bool = True) -> DataFrame:
    """``n`` rows of every class (all rows of a smaller class), united and
    sorted by ``key``.

    Rows are taken in MD5-of-key order, a fixed pseudo-random order. A full
    sort per class would send every row of a class through one task, so the
    operator first counts each class's rows by the number of zero bits that their hash
    starts with (a partial aggregate; at most 65 rows per class), picks per
    class the cut-off that keeps ``n`` rows at least, and ranks only those
    rows (about ``2n`` per class). The result is exactly the first ``n`` rows
    of each class in hash order. ``label`` must be a class: more than
    ``MAX_CLASSES`` distinct values are an error. Rows with a NULL key are
    left out.
    """
    d = df.where(F.col(key).isNotNull()).withColumn("_h", order_hash(key))
    number = F.conv("_h", 16, 10).cast("decimal(20,0)")
    # hashes below 2^j: j = 64 less the zero bits that the hash starts with
    bits = F.when(number == 0, 0).otherwise(F.length(F.conv("_h", 16, 2)))
    counts = d.groupBy(label, bits.alias("_bits")).agg(F.count(F.lit(1)).alias("n")).limit(65 * MAX_CLASSES + 1).collect()
    by_class: dict = {}
    for row in counts:
        by_class.setdefault(row[label], {})[row["_bits"]] = row["n"]
    if len(by_class) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values; it is no class")
    keep = None
    for cls, held in by_class.items():
        cond = F.col(label).isNull() if cls is None else F.col(label) == F.lit(cls)
        total = 0
        for j in sorted(held):
            total += held[j]
            if total >= n:
                if j < 4 * _ORDER_HEX:
                    cond = cond & (F.col("_h") < F.lit(format(1 << j, f"0{_ORDER_HEX}x")))
                break
        keep = cond if keep is None else keep | cond
    if keep is None:
        return df.limit(0)
    w = Window.partitionBy(label).orderBy("_h", key)
    out = (d.where(keep).withColumn("_rank", F.row_number().over(w))
             .where(F.col("_rank") <= n).drop("_rank", "_h"))
    return out.orderBy(key) if sort else out


def _split_bounds(weights) -> list[str]:
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative with a positive sum")
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(format(min(int(acc * 16 ** _SPLIT_HEX), 16 ** _SPLIT_HEX - 1), f"0{_SPLIT_HEX}x"))
    return bounds


def split_key(key: str, seed) -> Column:
    """First 8 hex digits of ``md5(key || ':' || seed)``."""
    return F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, _SPLIT_HEX)


def with_split(df: DataFrame, weights=(0.6, 0.4), key: str = "qid", seed: int = 24,
               name: str = "split", method: str = "hash") -> DataFrame:
    """Add the part number (0, 1, ...) each row falls in.

    ``method="hash"`` (default) uses the MD5 of ``key`` and ``seed``;
    ``"random"`` uses ``rand(seed)`` like ``randomSplit``, whose outcome
    depends on how the input is partitioned.
    """
    if method == "random":
        u, bounds = F.rand(seed), [float(b) for b in _cumulative(weights)]
    else:
        u, bounds = split_key(key, seed), _split_bounds(weights)
    part = F.lit(len(weights) - 1)
    for i, b in reversed(list(enumerate(bounds))):
        part = F.when(u < F.lit(b), F.lit(i)).otherwise(part)
    return df.withColumn(name, part.cast("int"))


def _cumulative(weights):
    total, acc, out = float(sum(weights)), 0.0, []
    for w in weights[:-1]:
        acc += w / total
        out.append(acc)
    return out


def hash_split(df: DataFrame, weights=(0.6, 0.4), key: str = "qid", seed: int = 24) -> list[DataFrame]:
    """Split like ``randomSplit`` but by key hash: part ``i`` holds rows whose
    hash falls in the ``i``-th slice of ``[0, 1)``. Each part is a filter
    over the same input (no shuffle); parts are disjoint and cover every
    row, whatever the partitioning."""
    u = split_key(key, seed)
    bounds = _split_bounds(weights)
    parts = []
    for i in range(len(weights)):
        cond = F.lit(True)
        if i > 0:
            cond = cond & (u >= F.lit(bounds[i - 1]))
        if i < len(bounds):
            cond = cond & (u < F.lit(bounds[i]))
        parts.append(df.where(cond))
    return parts
