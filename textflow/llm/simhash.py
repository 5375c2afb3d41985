"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint of 64 bits is cut into ``FAMILIES`` blocks of 16 bits. Two
fingerprints that differ in ``bits`` bits at most differ in
``bits // FAMILIES`` at most in one block. The anchors of a block are the words of a covering
code: the Hamming code of length 15 with one more free bit, whose covering
radius is 1. A fingerprint's home is its nearest anchor; it is also replicated to every
anchor within covering radius plus the block's threshold, so that a
linked pair meets at the home of either one. Fingerprints are compared at
each anchor over all 64 bits.

Equal fingerprints are folded before they are replicated. An anchor with many
homes is split by the anchors of the other blocks in turn: a pair that
meets there differs in ``bits // (FAMILIES - 1)`` bits at most in one of them. Very
large ones are split into parts as well, whose homes are divided and whose visitors
go to every part. Of the pairs found, a task returns only a forest that
connects the same fingerprints.

Defined cases: a null or empty text, or one without words, has fingerprint
zero, linked like any other; a text of fewer words than a shingle is one
shingle; repeated rows are linked as equal; null ids are never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ASCII_LOWER, as_bytes, cut, gathered, groups

SHINGLE, BITS, SEED = 4, 4, 42
FAMILIES, BLOCK = 4, 16
#: Homes of an anchor that isn't split; as many visitors as so many homes have split it as well.
HOMES = 4096
#: Anchors that a fingerprint visits, about: 137 of 65,536 words are near, 4,096 of which are anchors.
VISITS = 9
_SLICE = 1 << 14
#: Bits of a place that follow the first anchor: the second one's family and anchor, and a part.
_SALT = 20
_SECOND = 3 + BLOCK + _SALT


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned; bit i is set if it is set in over half of the hashes."""
    from xxhash import xxh64_intdigest

    words = text.translate(ASCII_LOWER).split() if text else []  # splits at bytes 9 to 13 and 32
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        part = range(i, min(n, i + _SLICE))
        hashes = np.fromiter([xxh64_intdigest(line[starts[k]:ends[k]], SEED) for k in part], np.uint64, len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a ``bigint`` of the same 64 bits."""
    @F.arrow_udf("bigint")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint_of(t, shingle) for t in as_bytes(batch)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints.asNondeterministic()(text)


# --- the covering code of a block ---


def _near(block_bits: int, weight: int) -> list[int]:
    """Words of up to ``weight`` set bits, lightest first."""
    words = [0]
    layer = [0]
    for _ in range(weight):
        layer = sorted({w | 1 << i for w in layer for i in range(block_bits) if not w >> i & 1})
        words += layer
    return words


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Of the Hamming code over bits 0 to 14: the sum (exclusive or) of the
    positions, counted from 1, of the set bits. Zero for the code's words; bit
    15 is free."""
    out = np.zeros_like(values)
    for i in range(BLOCK - 1):
        out ^= np.where(values >> i & 1, i + 1, 0).astype(values.dtype)
    return out


def homes(values: np.ndarray) -> np.ndarray:
    """Nearest anchor: the bit that the syndrome names is flipped."""
    wrong = _syndrome(values)
    return values ^ np.where(wrong > 0, 1 << np.maximum(wrong, 1) - 1, 0).astype(values.dtype)


def visits(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: every anchor within 1 + threshold of each value."""
    rows, anchors = [], []
    for word in _near(BLOCK, 1 + threshold):
        moved = values ^ values.dtype.type(word)
        at = np.flatnonzero(_syndrome(moved) == 0)
        rows.append(at)
        anchors.append(moved[at])
    return np.concatenate(rows), np.concatenate(anchors)


def _block(prints: np.ndarray, family: int) -> np.ndarray:
    return (prints >> np.uint64(BLOCK * family) & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)


def _visitors(prints: np.ndarray, family: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors, and whether the anchor is the row's home."""
    block = _block(prints, family)
    row, anchor = visits(block, threshold)
    return row, anchor, anchor == homes(block)[row]


# --- linking ---


def _forest(own: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect whatever is within ``bits`` of an
    entry of ``own``; a fingerprint linked with nothing but itself has none."""
    parent = np.arange(len(others))

    def top(i: np.ndarray) -> np.ndarray:
        while (up := parent[i])[up != i].size:
            i = up
        return i

    for start in range(0, len(own), 64):
        near = np.bitwise_count(own[start:start + 64, None] ^ others[None, :]) <= bits
        for row in near[near.sum(axis=1) > 1]:
            linked = np.flatnonzero(row)
            roots = np.unique(top(linked))
            parent[roots] = roots[0]
            parent[linked] = roots[0]
    root = top(np.arange(len(others)))
    at = np.flatnonzero(root != np.arange(len(others)))
    return others[at], others[root[at]]


def links(prints: DataFrame, column: str = "fp", bits: int = BITS, most: int = HOMES) -> DataFrame:
    """``(a, b)``: edges that connect all fingerprints within ``bits`` of
    each other (their transitive closure; not every pair is listed).
    ``column`` is a distinct, non-null ``bigint``."""
    threshold = bits // FAMILIES
    prints = prints.select(F.col(column).alias("fp"))

    def counted(batches):
        at_home, near = (np.zeros((FAMILIES, 1 << BLOCK), np.int64) for _ in range(2))
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(whole), _SLICE):
                fp = whole[start:start + _SLICE]
                for family in range(FAMILIES):
                    _, anchor, home = _visitors(fp, family, threshold)
                    near[family] += np.bincount(anchor, minlength=1 << BLOCK)
                    at_home[family] += np.bincount(anchor[home], minlength=1 << BLOCK)
        family, anchor = np.nonzero(near)
        yield pa.RecordBatch.from_pydict({"family": pa.array(family, pa.int32()), "anchor": pa.array(anchor, pa.int32()),
                                          "homes": at_home[family, anchor], "visitors": near[family, anchor]})

    # FAMILIES * 4096 anchors at most, whatever the input; without homes there is nothing to compare at one
    anchors = {(r.family, r.anchor): max(r.homes, r.visitors // VISITS)
               for r in prints.mapInArrow(counted, "family int, anchor int, homes bigint, visitors bigint")
               .groupBy("family", "anchor").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors")).where(F.col("homes") > 0).collect()}

    def replicate(batches):
        held = np.full((FAMILIES, 1 << BLOCK), -1, np.int64)
        for (family, anchor), n in anchors.items():
            held[family, anchor] = n if n > most else 0

        def rows(place, home, fp):
            return pa.RecordBatch.from_pydict({"place": place, "home": home, "fp": fp.view(np.int64)})

        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(whole), _SLICE):
                fp = whole[start:start + _SLICE]
                for family in range(FAMILIES):
                    row, anchor, home = _visitors(fp, family, threshold)
                    first = (family << BLOCK | anchor.astype(np.int64)) << _SECOND
                    many = held[family, anchor]
                    yield rows(first[many == 0], home[many == 0], fp[row[many == 0]])
                    at = np.flatnonzero(many > 0)
                    for other in range(FAMILIES if at.size else 0):
                        if other == family:
                            continue
                        near, second, home_too = _visitors(fp[row[at]], other, bits // (FAMILIES - 1))
                        i = at[near]
                        parts = 1 + many[i] // (most << 6)
                        salt = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        j = np.repeat(np.arange(len(i)), parts)
                        own = fp[row[i[j]]] % parts[j].astype(np.uint64) == salt.astype(np.uint64)
                        place = first[i[j]] + (((other + 1) << BLOCK | second[j].astype(np.int64)) << _SALT) + salt
                        yield rows(place, (home[i] & home_too)[j] & own, fp[row[i[j]]])

    def compare(batches):
        for table in groups(batches, "place"):
            fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
            if len(fp) > 1 and home.any():
                a, b = _forest(fp[home], fp, bits)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = prints.mapInArrow(replicate, "place bigint, home boolean, fp bigint")
    return gathered(placed, "place").mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, fp: str = "fp", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``(fp, component_id)`` for every distinct fingerprint of ``docs``:
    the smallest id of a row reachable from it. ``docs`` is read more than
    once; give a table whose fingerprints are written."""
    folded = cut(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")))
    found = components(links(folded, "fp", bits))
    rooted = (folded.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return rooted.join(smallest, "root").select("fp", "component_id")


def with_component(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                   bits: int = BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``;
    ``fingerprint`` as 16 lowercase hex digits."""
    marked = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    named = near_duplicates(marked, bits=bits)
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                  bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id
    (null ids last; among equal ids any one)."""
    row, mark = "__row", "__fp"
    marked = cut(docs.withColumns({row: F.monotonically_increasing_id(), mark: fingerprint(F.col(text), shingle)}))
    ids = marked.select(F.col(row), F.col(mark).alias("fp"), F.col(doc_id).alias("doc_id"))
    named = components(links(ids.select("fp").distinct(), "fp", bits)).withColumnRenamed("node", "fp")
    kept = (ids.join(named, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)))
    return marked.join(kept.select(row), row, "left_semi").drop(row, mark)
