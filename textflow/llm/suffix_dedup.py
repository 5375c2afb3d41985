"""Suffix-array dedup: bytes of repeated strings, by two-stage suffix sorting.

Every string of ``length`` bytes that starts at more than one place, in one text or
in two, is found, and the bytes that such strings cover are removed. The work
is split so that equal strings always meet:

1. Each window of ``length`` bytes names an anchor, the gram (of 64 bytes, for
   400) in it with the smallest hash, the first of equals. Neighbouring windows with the same
   anchor form a context. Equal windows have equal anchors, so a repeated string lies in
   contexts of one anchor gram.
2. Equal contexts of an anchor gram are folded into one with a count; contexts
   whose gram occurs once are done.
3. The folded contexts that are left are sorted by suffix, in bins that hold
   all contexts of a gram: suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets, and the common
   prefixes of neighbours are computed. A prefix of ``length`` bytes is a
   repeat.
4. The windows found go back to every occurrence of their context.

A gram with more than ``MOST`` different contexts is not put into one bin:
its windows are dealt out by their own hash, each bin then holding the
equal windows only, counted before the shuffle. That is exact as well.

Defined cases: a null or empty text has no bytes and no spans; a text shorter
than ``length`` loses nothing; repeated rows are repeats of each other; matches
never cross texts; a span may start or end inside a UTF-8 character, which
is why what is left is binary; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, cut, gathered, groups

LENGTH = 400
#: Different contexts of a gram that go into one bin.
MOST = 2048
#: Bytes that are sorted at once; a gram's contexts may exceed it.
BIN = 96 << 10
ROW = "__row"
_PLACE = 20  # bits of a place in a piece of text
_END = 0xFF  # no byte of UTF-8


# --- anchors ---


def _words_at(text: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    return np.ndarray((count,), "<u8", text, strides=(1,))


def gram_length(length: int) -> int:
    """Bytes of an anchor gram: a power of two, a sixth of ``length`` or less.
    Long enough that texts rarely share one by chance, short enough that a window holds
    many."""
    gram = 8
    while 12 * gram <= length:
        gram *= 2
    return gram


def _gram_hashes(text: np.ndarray, total: int, gram: int) -> np.ndarray:
    """The hash of each gram of the first ``total`` bytes, by doubling."""
    h, n = _words_at(text, total - 7) * np.uint64(0x9E3779B97F4A7C15), 8
    while n < gram:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15) + h[n:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        n *= 2
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _first_smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of each ``width`` neighbours."""
    low, step = keys, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return low if step == width else np.minimum(low[:len(keys) - width + 1], low[width - step:])


def contexts_of(parts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(part, first, last, gram hash)``: the windows' starts ``first`` to
    ``last`` of a part share the anchor. The parts hold less than
    ``2 ** _PLACE`` bytes together."""
    text = np.frombuffer(b"".join([*parts, bytes(16)]), np.uint8)
    total = len(text) - 16
    if total < length:
        return
    gram = gram_length(length)
    hashes = _gram_hashes(text, total, gram)
    place = np.uint64((1 << _PLACE) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_first_smallest(keys, length - gram + 1) & place).astype(np.int64)
    at = 0
    for number, part in enumerate(parts):
        n = len(part) - length + 1
        if n > 0:
            own = anchor[at:at + n]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            last = np.append(first[1:] - 1, n - 1)
            yield from zip([number] * len(first), first.tolist(), last.tolist(),
                           hashes[own[first]].view(np.int64).tolist(), strict=True)
        at += len(part)


def _cut_up(texts: list[bytes | None], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """``([(text, offset)], parts)`` of bounded size; a long text is cut into
    parts that overlap so that each window is in one of them."""
    most = (1 << _PLACE) - 1
    names, parts, held = [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for offset in range(0, len(text) - length + 1, most - length + 1):
            part = text[offset:offset + most]
            if held + len(part) > most:
                yield names, parts
                names, parts, held = [], [], 0
            names.append((i, offset))
            parts.append(part)
            held += len(part)
    if parts:
        yield names, parts


def _contexts(length: int):
    def contexts(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows = batch.column(ROW).to_numpy()
            for names, parts in _cut_up(as_bytes(batch.column("text")), length):
                found = list(contexts_of(parts, length))
                if not found:
                    continue
                number, first, last, key = map(np.array, zip(*found, strict=True))
                whole = np.array([xxh3_64_intdigest(parts[i][a:b + length]) for i, a, b, _ in found], np.uint64)
                text, offset = np.array(names, np.int64).T
                yield pa.RecordBatch.from_pydict({
                    "key": key.astype(np.int64), "context": whole.view(np.int64), ROW: rows[text[number]],
                    "first": (offset[number] + first).astype(np.int32), "last": (offset[number] + last).astype(np.int32)})
    return contexts


# --- suffix sorting ---


def _sorted_directly(text: bytes, t: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` by their suffixes, one bucket of two first bytes after the
    other, so that only one bucket's prefixes are held at a time."""
    if not starts.size:
        return starts
    two = t[starts].astype(np.int32) << 8 | t[starts + 1]
    starts = starts[np.argsort(two, kind="stable")]
    edges = np.flatnonzero(np.diff(np.sort(two))) + 1
    key = lambda i: text[i + 2:i + depth]
    return np.concatenate([np.array(sorted(b.tolist(), key=key)) if len(b) > 1 else b for b in np.split(starts, edges)])


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first ``depth`` bytes at
    least. Stage one sorts the suffixes smaller than their successors; stage
    two takes the buckets of first bytes in turn and places before each suffix
    its predecessor, where that one is the larger."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    ups = np.zeros(n, np.bool_)  # smaller than the successor; the last suffix isn't
    change = np.flatnonzero(t[1:] != t[:-1])  # within a run of equal bytes the type is that of its end
    ups[change] = t[change] < t[change + 1]
    ends = np.append(change, n - 1)
    ups = ups[np.repeat(ends, np.diff(ends, prepend=-1))]
    direct = _sorted_directly(text, t, np.flatnonzero(ups), depth)
    first = t[direct]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        bucket = [level]
        while level.size:  # runs of the bucket's byte
            before = level[level > 0] - 1
            level = before[t[before] == byte]
            bucket.append(level)
        a, b = np.searchsorted(first, [byte, byte + 1])
        done = np.concatenate([*bucket, direct[a:b]])
        order.append(done)
        before = done[done > 0] - 1
        before = before[t[before] > byte]
        if before.size:
            own = t[before]
            before = before[np.argsort(own, kind="stable")]
            sizes = np.bincount(own, minlength=256)
            for later, part in zip(np.flatnonzero(sizes), np.split(before, np.cumsum(sizes[sizes > 0])[:-1]), strict=True):
                waiting[later].append(part)
    return np.concatenate(order)


def repeated(parts: list[bytes], length: int) -> np.ndarray:
    """Marks every place of the parts, joined with an end byte after each, where a
    string of ``length`` bytes starts that also starts at another."""
    text = _END.to_bytes().join([*parts, b""])
    starts = np.zeros(len(text), np.bool_)
    at = 0
    for part in parts:
        starts[at:at + max(0, len(part) - length + 1)] = True
        at += len(part) + 1
    order = suffix_order(text, length)
    order = order[starts[order]]
    a, b = order[:-1], order[1:]
    words = _words_at(np.frombuffer(text + bytes(8), np.uint8), len(text))
    for offset in range(0, length, 8):  # neighbours that agree so far
        offset = min(offset, length - 8)
        same = words[a + offset] == words[b + offset]
        a, b = a[same], b[same]
        if not a.size:
            break
    marks = np.zeros(len(text), np.bool_)
    marks[a] = marks[b] = True
    return marks


def _runs(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


_RUNS = "array<struct<first:int,last:int>>"
_RUNS_KIND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _sorted_bins(length: int):
    def bins(batches):
        held, size = [], 0
        for table in groups(batches, "key"):
            held.append(table)
            size += sum(map(len, table.column("data").to_pylist()))
            if size >= BIN:
                yield result(held)
                held, size = [], 0
        if held:
            yield result(held)

    def result(tables):
        table = pa.concat_tables(tables)
        parts = table.column("data").to_pylist()
        marks, at, runs = repeated(parts, length), 0, []
        for part in parts:
            runs.append(_runs(marks[at:at + len(part)]))
            at += len(part) + 1
        out = table.select(["key", "context"]).append_column("runs", pa.array(runs, _RUNS_KIND)).combine_chunks()
        return out.to_batches()[0]

    return bins


def _windows(length: int):
    """(key, context, at, window): one row for each window of a context."""
    def windows(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for key, context, data in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "data")), strict=True):
                n = len(data) - length + 1
                yield pa.RecordBatch.from_pydict({
                    "key": np.full(n, key), "context": np.full(n, context), "at": np.arange(n, dtype=np.int32),
                    "window": [xxh3_128_digest(data[i:i + length]) for i in range(n)]})
    return windows


# --- the whole ---


_DATA = "key bigint, context bigint, kinds bigint, data binary"


def _cut_out(length: int):
    """The bytes of the contexts asked for: a text comes once, with all of its own."""
    def bytes_of(batches):
        for batch in batches:
            held, size = [], 0
            for text, asked in zip(batch.column("text"), batch.column("asked"), strict=True):
                raw = text.as_py().encode()
                for c in asked.as_py():
                    held.append((c["key"], c["context"], c["kinds"], raw[c["first"]:c["last"] + length]))
                    size += len(held[-1][-1])
                if size > 4 << 20:
                    yield table(held)
                    held, size = [], 0
            yield table(held)

    def table(held):
        columns = zip(*held, strict=True) if held else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          ["key", "context", "kinds", "data"])

    return bytes_of


def repeats(rows: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """``(__row, runs)``: starts (first to last) of the repeated strings of each text.
    ``rows`` has ``__row`` (unique) and ``text`` and is read more than once."""
    found = cut(rows.where(F.octet_length("text") >= length).select(ROW, "text").mapInArrow(
        _contexts(length), f"key bigint, context bigint, {ROW} bigint, first int, last int"))
    folded = cut(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct(ROW, "first", "last")).alias("one")))
    kinds = folded.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # only contexts that stand alone need a partner; those of their gram are what they are sorted with
    single = folded.where("n = 1").select("key").join(kinds, "key").distinct()
    asked = (folded.join(single, "key").select(f"one.{ROW}", F.struct("key", "context", "kinds", "one.first", "one.last").alias("c"))
             .groupBy(ROW).agg(F.collect_list("c").alias("asked")))
    data = cut(rows.select(ROW, "text").join(asked, ROW).select("text", "asked").mapInArrow(_cut_out(length), _DATA))
    binned = (gathered(data.where(F.col("kinds") <= most).select("key", "context", "data"), "key")
              .mapInArrow(_sorted_bins(length), f"key bigint, context bigint, runs {_RUNS}"))
    windows = data.where(F.col("kinds") > most).mapInArrow(_windows(length), "key bigint, context bigint, at int, window binary")
    equal = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    dealt = (windows.join(equal, "window").groupBy("key", "context")
             .agg(F.transform(F.collect_list("at"), lambda i: F.struct(i.alias("first"), i.alias("last"))).alias("runs")))
    alone = binned.unionByName(dealt).where(F.size("runs") > 0).join(folded.where("n = 1").select("key", "context"), ["key", "context"], "left_semi")
    copied = folded.where("n > 1").select(
        "key", "context", F.array(F.struct(F.lit(0).alias("first"), (F.col("one.last") - F.col("one.first")).alias("last"))).alias("runs"))
    places = found.join(cut(alone.unionByName(copied)), ["key", "context"])  # a common context's places can be split
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), (r["last"] + F.col("first")).alias("last")))
    return places.groupBy(ROW).agg(F.flatten(F.collect_list(moved)).alias("runs"))


def _kept(length: int):
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for i, text in enumerate(as_bytes(texts)):
            if not runs[i].is_valid:
                out.append({"spans": [], "kept": text or b""})
                continue
            own = runs[i].values
            edges = np.zeros(len(text) + 1, np.int64)
            np.add.at(edges, own.field("first").to_numpy(), 1)
            np.add.at(edges, own.field("last").to_numpy() + length, -1)
            gone = np.cumsum(edges[:-1]) > 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
            out.append({"spans": [{"start": a, "end": b} for a, b in zip(change[::2], change[1::2], strict=True)],
                        "kept": np.frombuffer(text, np.uint8)[~gone].tobytes()})
        return pa.array(out, kind)

    return F.arrow_udf(kept, "struct<spans:array<struct<start:int,end:int>>,kept:binary>").asNondeterministic()


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """``docs`` with ``spans`` (maximal runs of removed bytes, ``end``
    exclusive) and ``kept`` (the other bytes); columns of these names are replaced."""
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    runs = repeats(rows.select(ROW, F.col(text).alias("text")), length, most).withColumnRenamed("runs", "__runs")
    out = rows.join(runs, ROW, "left").withColumn("__kept", _kept(length)(F.col(text), F.col("__runs")))
    return (out.withColumn("spans", F.col("__kept.spans")).withColumn("kept", F.col("__kept.kept")).drop("__kept", "__runs", ROW))
