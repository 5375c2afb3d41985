"""Line dedup by pairwise alignment.

Every line (without the white space around it) is hashed. A line's owner is
the first document that holds it; so is that of a run of neighbouring lines. A
later document is paired with an owner if they share a line of ``MIN_WORDS`` words, a
run of lines of ``ENOUGH`` words, or the whole text, rare or common alike: a
common line pairs each holder with its owner alone. Each pair is aligned by patience diff over all its
lines, and the blocks of aligned neighbouring lines are deleted from the later
document. What the alignment leaves, as it stands in another order or is repeated,
is matched run by run: any run of lines of the later document that its owner
holds is a block as well. (These blocks go beyond the alignment; a copy with its parts
swapped is a copy too.)

A document is paired with the owners of its lines and runs, not with every other
holder: pairs grow with the lines, and a line in a third of all documents
costs a row for each of them. From each shorter line two runs start, the shortest ones
of ``ENOUGH`` words that begin and that end with it. Neighbouring lines of
``ENOUGH`` words that stand in any earlier document are made of such runs and of longer lines, and
of each the owner is at least as early, so all of them are deleted. A block counts if one of its
lines has ``MIN_WORDS`` words at least, or all of them ``ENOUGH``, or if it is
the whole text. What counts as a word in scripts without spaces: see ``weight``.

Defined cases: a null text stays null and an empty one empty; blank lines are
aligned like others but make no block; documents are ordered by id, null ids
last, and rows with the same id in the order in which they are read, so that
the second of two repeated rows loses its lines; an empty table gives an empty
table; further columns are kept, and columns of the names added are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, cut

#: A line with as many words is an overlap by itself, however many documents hold it; a shorter one neither pairs documents nor makes a block by itself.
MIN_WORDS = 5
#: So is a run of shorter lines with as many words.
ENOUGH = 2 * MIN_WORDS
#: First bytes of characters of scripts without spaces: Thai, Lao, Burmese, Khmer, Kana, Han.
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9]|\xef[\xa4-\xab]|\xf0[\xa0-\xbf]")
ROW, ORDER = "__row", "__order"


def _sequences(batches):
    """Rows (row, order, hashes, weights, keys): the hash and the words
    (``ENOUGH`` at most) of every line, and the different hashes of what is an overlap by
    itself: lines of ``MIN_WORDS`` words, runs of lines, and the whole text."""
    from xxhash import xxh3_64_intdigest

    signed = lambda hashes: np.array(hashes, np.uint64).view(np.int64)
    for batch in batches:
        for start in range(0, len(batch), 512):
            part = batch.slice(start, 512)
            hashes, weights, overlaps = [], [], []
            for text in as_bytes(part.column("text")):
                lines = [line.strip() for line in text.split(b"\n")] if text else []
                found = {line: (xxh3_64_intdigest(line), weight(line)) for line in lines}
                own = signed([found[line][0] for line in lines])
                size = [found[line][1] for line in lines]
                raw = own.tobytes()
                hashes.append(own)
                weights.append(np.array(size, np.int8))
                # seeded, so that a text or a run of one line differs from the line
                keys = {h for h, w in found.values() if w >= MIN_WORDS}
                keys.update(xxh3_64_intdigest(raw[8 * p:8 * q], 2) for p, q in windows(size))
                if any(size):
                    keys.add(xxh3_64_intdigest(b"\n".join(lines), 1))
                overlaps.append(signed(list(keys)))
            yield pa.RecordBatch.from_arrays(
                [part.column(ROW), part.column(ORDER), pa.array(hashes, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int8())),
                 pa.array(overlaps, pa.list_(pa.int64()))],
                [ROW, ORDER, "hashes", "weights", "keys"])


def weight(line: bytes) -> int:
    """The words of a line, ``ENOUGH`` at most. In scripts without spaces two
    characters are a word; whatever the script, 16 characters are one at least."""
    words = len(line.split(None, ENOUGH - 1))
    if words < ENOUGH and not line.isascii():
        words += len(UNSPACED.findall(line)) // 2
    if words < ENOUGH and len(line) >= 32:
        words = max(words, len(line.decode("utf-8", "replace")) // 16)
    return min(ENOUGH, words)


def windows(weights: list[int]) -> set[tuple[int, int]]:
    """Runs (first, end) of lines: for every line that isn't blank and has
    fewer than ``MIN_WORDS`` words, the shortest run of ``ENOUGH`` words that
    begins with it and the shortest one that ends with it."""
    found, n = set(), len(weights)
    end = total = 0
    for p, w in enumerate(weights):
        while end < n and total < ENOUGH:
            total += weights[end]
            end += 1
        if total < ENOUGH:
            break
        if 0 < w < MIN_WORDS:
            found.add((p, end))
        total -= w
    first, total = n, 0
    for q in range(n, 0, -1):
        while first > 0 and total < ENOUGH:
            first -= 1
            total += weights[first]
        if total < ENOUGH:
            break
        w = weights[q - 1]
        if 0 < w < MIN_WORDS:
            found.add((first, q))
        total -= w
    return found


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two sequences, ascending in both. Equal ends
    are matched; between them the longest ascending chain of items that are
    unique on both sides, and so on within the gaps of the chain."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            matched.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: k for k, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        unique = [(k, place[x]) for k, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in place]
        chain = _ascending(unique)
        ends = [(i - 1, j - 1), *chain, (i_end, j_end)]
        matched += chain
        if chain:
            todo += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(ends, ends[1:], strict=False)]
    return sorted(matched)


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain ascending in the second place (the first ascends)."""
    tops, last, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def equal_runs(mine: list, theirs: list) -> list[tuple[int, int]]:
    """Line numbers (first, last) in ``mine`` of the longest runs of
    neighbouring lines that stand somewhere in ``theirs``, by a suffix
    automaton of ``theirs``: linear in both."""
    step, link, size, last = [{}], [-1], [0], 0
    for x in theirs:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p, last = last, new
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p < 0:
            continue
        q = step[p][x]
        if size[q] > size[p] + 1:
            copy = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            while p >= 0 and step[p].get(x) == q:
                step[p][x] = copy
                p = link[p]
            link[q] = q = copy
        link[new] = q
    found, at, n = [], 0, 0
    for k, x in enumerate(mine):
        before = n
        while at and x not in step[at]:
            at = link[at]
            n = size[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
        if before and n != before + 1:
            found.append((k - before, k - 1))
    if n:
        found.append((len(mine) - n, len(mine) - 1))
    return found


def blocks(mine: list[int], theirs: list[int], weights: list[int]) -> list[tuple[int, int]]:
    """Line numbers (first, last) in ``mine`` of the blocks: aligned ones,
    and what else is left of runs that ``theirs`` holds. ``weights`` are the words of ``mine``."""
    if mine == theirs and any(weights):
        return [(0, len(mine) - 1)]
    counts = lambda a, b: max(weights[a:b + 1]) >= MIN_WORDS or sum(weights[a:b + 1]) >= ENOUGH
    found, run = [], []
    for i, j in [*patience(mine, theirs), (-1, -1)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if counts(run[0][0], run[-1][0]):
                found.append((run[0][0], run[-1][0]))
            run = []
        run.append((i, j))
    left = [True] * len(mine)
    for a, b in found:
        left[a:b + 1] = [False] * (b + 1 - a)
    held = set(theirs)
    if any(w and x and h in held for w, x, h in zip(weights, left, mine, strict=True)):
        for a, b in equal_runs(mine, theirs):
            if not counts(a, b):
                continue
            while a <= b:
                end = a
                while end <= b and left[end]:
                    end += 1
                if any(weights[a:end]):
                    found.append((a, end - 1))
                    left[a:end] = [False] * (end - a)
                a = end + 1
    return found


def _aligned(batches):
    """The blocks of each pair."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            columns = [part.column(c).to_pylist() for c in ("mine", "theirs", "weights")]
            found = [[{"first": a, "last": b} for a, b in blocks(m, t, w)] for m, t, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(found, kind)], [ROW, "runs"])


def removals(docs: DataFrame) -> DataFrame:
    """``(__row, runs array<struct<first,last>>, n_partners)`` of the documents
    that lose lines. ``docs`` has ``__row`` (unique), ``__order`` (sorts the
    documents, unique) and ``text``."""
    kind = docs.schema[ORDER].dataType.simpleString()
    docs = cut(docs.select(ROW, ORDER, "text").where("text <> ''").mapInArrow(
        _sequences, f"{ROW} bigint, {ORDER} {kind}, hashes array<bigint>, weights array<tinyint>, keys array<bigint>"))
    lines = docs.select(ROW, ORDER, F.explode("keys").alias("h"))
    # written, so that the join below gets plain exchanges, of which Spark can split a common line's
    owners = cut(lines.groupBy("h").agg(F.count("*").alias("df"), F.min(ORDER).alias("first"))
                 .where("df > 1").select("h", F.col("first.row").alias("owner")))
    pairs = lines.join(owners, "h").where(F.col(ROW) != F.col("owner")).select(ROW, "owner").distinct()
    theirs = docs.select(F.col(ROW).alias("owner"), F.col("hashes").alias("theirs"))
    both = (pairs.join(docs.select(ROW, F.col("hashes").alias("mine"), "weights"), ROW)
            .join(theirs, "owner").select(ROW, "mine", "theirs", "weights"))
    found = both.mapInArrow(_aligned, f"{ROW} bigint, runs array<struct<first:int,last:int>>").where(F.size("runs") > 0)
    return found.groupBy(ROW).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.count("*").cast("int").alias("n_partners"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the aligned blocks deleted from ``text``, and with
    ``n_lines`` (lines of the input, blank ones included), ``n_removed``,
    ``n_blocks`` and ``n_partners`` (owners that blocks were shared with)."""
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(ROW).alias("row"))
    gone = removals(rows.select(ROW, order.alias(ORDER), F.col(text).alias("text")))
    lines = F.split(F.col(text), "\n", -1)
    run = lambda i: F.exists("runs", lambda r: i.between(r["first"], r["last"]))
    kept = F.filter(lines, lambda _, i: ~run(i))
    out = rows.drop("runs", "n_partners").join(gone, ROW, "left")
    return out.withColumns({
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("int"),
        "n_removed": F.when(F.col("runs").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("int"),
        "n_blocks": F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("int"),
        "n_partners": F.coalesce("n_partners", F.lit(0)),
        text: F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).drop(ROW, "runs")
