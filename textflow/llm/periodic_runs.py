"""Periodic runs of words, found by recompression.

The words of a batch of texts are numbered and strung together, every text
closed by a symbol of its own. The string is compressed by turns: block
compression replaces each maximal repetition of one symbol by a symbol for
(symbol, length); pair compression deals the symbols to two sides by a hash and
replaces each neighbouring pair (left, right). Equal substrings are compressed
alike but for their rims, so the levels form a run-length grammar in which the
longest common extension of two places takes a constant number of steps a
level: up while the symbols agree, then down to the first that differs. The
same levels read from the right give extensions to the left.

A run with period q holds two neighbouring multiples of q, and the words there
agree. So the candidates of period q are the stretches of agreeing neighbours on
the grid of multiples of q, in all n/1 + n/2 + ... places; a stretch must be as
long as a run makes it at least. Extensions to both sides of one of its places give the
exact run, and resolve the places of the stretch that the run covers. A run found
with several periods keeps the smallest; they divide each other, since a run is
three periods long at least.

Defined cases: a null or empty text has no words and no runs; runs never cross
texts; repeated rows are done one by one; a very long text is one batch, whose
memory grows with its words; extra columns are kept, and columns of the names
added are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes

#: A run is as many words long, and as many periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words of a batch; a longer text is a batch by itself.
BATCH_WORDS = 1 << 18
#: Candidates whose extensions are taken at once.
STEP = 1 << 18
#: The white space of the contract, as one byte.
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level:
    """One string of the grammar and how it makes the next: ``parent`` of
    each place, whether it ``opens`` its parent, ``left`` symbols of its block
    from here on (1 for a pair level), and ``child``, the first place of each parent."""

    def __init__(self, symbols, parent=None, opens=None, left=None, child=None):
        self.symbols, self.parent, self.opens, self.left, self.child = symbols, parent, opens, left, child

    def mirrored(self) -> Level:
        if self.parent is None:
            return Level(self.symbols[::-1])
        n, closes = len(self.symbols), np.append(self.opens[1:], True)
        ends = np.flatnonzero(closes)
        size = ends - self.child  # of each parent, less one
        left = None if self.left is None else (np.arange(n) - self.child[self.parent] + 1)[::-1]
        return Level(self.symbols[::-1], (len(size) - 1 - self.parent)[::-1], closes[::-1], left, (n - 1 - ends)[::-1])


def _blocks(symbols: np.ndarray) -> tuple[Level, np.ndarray]:
    n = len(symbols)
    opens = np.ones(n, bool)
    np.not_equal(symbols[1:], symbols[:-1], out=opens[1:])
    child = np.flatnonzero(opens)
    size = np.diff(child, append=n)
    parent = np.cumsum(opens) - 1
    left = (child + size)[parent] - np.arange(n)
    _, named = np.unique(symbols[child].astype(np.int64) << 32 | size, return_inverse=True)
    return Level(symbols, parent, opens, left, child), named


def _pairs(symbols: np.ndarray, turn: int) -> tuple[Level, np.ndarray]:
    # a hash of the symbol deals it to a side
    mixed = (symbols.astype(np.uint64) + np.uint64(turn * 0x9E3779B9 + 1)) * np.uint64(0xD6E8FEB86659FD93)
    right = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63) > 0
    opens = np.ones(len(symbols), bool)
    np.logical_not(~right[:-1] & right[1:], out=opens[1:])
    child = np.flatnonzero(opens)
    double = np.append(~opens, False)[child + 1]
    second = np.where(double, symbols[np.minimum(child + 1, len(symbols) - 1)].astype(np.int64) + 1, 0)
    _, named = np.unique(symbols[child].astype(np.int64) << 32 | second, return_inverse=True)
    return Level(symbols, np.cumsum(opens) - 1, opens, None, child), named


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels of a string whose first and last symbols are unique, up to
    one in which no symbol occurs twice."""
    levels, turn, distinct = [], 0, len(np.unique(symbols))
    while distinct < len(symbols):
        block = turn % 2 == 0
        if not block or (symbols[1:] == symbols[:-1]).any():
            level, symbols = _blocks(symbols) if block else _pairs(symbols, turn)
            levels.append(level)
            distinct = int(symbols.max()) + 1  # symbols are numbered anew at each level
        turn += 1
    return [*levels, Level(symbols)]


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols agree from places ``i`` and ``j`` on (``i`` isn't ``j``)."""
    x, y, top = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    going = np.arange(len(i))
    for depth, level in enumerate(levels):
        a, b = x[going], y[going]
        same = level.symbols[a] == level.symbols[b]
        top[going] = depth
        going, a, b = going[same], a[same], b[same]
        if not len(going):
            break
        # at the last level no symbol occurs twice, so none agrees
        inside = ~(level.opens[a] & level.opens[b])
        if level.left is None:
            a, b, stop = a + inside, b + inside, np.zeros(len(a), bool)
        else:
            here, there = level.left[a], level.left[b]
            step = np.where(inside, np.minimum(here, there), 0)
            a, b, stop = a + step, b + step, inside & (here != there)
        # a block that ends earlier: the symbols that follow differ
        x[going[stop]], y[going[stop]] = a[stop], b[stop]
        on = ~stop
        going = going[on]
        x[going], y[going] = level.parent[a[on]], level.parent[b[on]]
    for depth in range(int(top.max(initial=0)) - 1, -1, -1):
        level, down = levels[depth], np.flatnonzero(top > depth)
        a, b = level.child[x[down]], level.child[y[down]]
        same = level.symbols[a] == level.symbols[b]
        step = same if level.left is None else np.where(same, np.minimum(level.left[a], level.left[b]), 0)
        x[down], y[down] = a + step, b + step
    return x - i


def _stretches(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods and the first and last multiples of them at which agreeing
    neighbours begin, of the stretches that are long enough."""
    found = []
    for q in range(1, longest // MIN_PERIODS + 1):
        grid = symbols[::q]
        agree = grid[:-1] == grid[1:]
        # a run agrees at (length - q) places in a row, of which the grid takes every q-th
        least = (max(MIN_LENGTH, MIN_PERIODS * q) - q) // q
        if not (agree[:-1] & agree[1:]).any():
            continue
        padded = np.zeros(len(agree) + 2, bool)
        padded[1:-1] = agree
        edge = np.flatnonzero(padded[1:] != padded[:-1])
        first, end = edge[::2], edge[1::2]
        enough = end - first >= least
        if enough.any():
            found.append((np.full(int(enough.sum()), q), first[enough], end[enough] - 1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers its runs: rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words = 1 + max((int(t.max(initial=0)) for t in texts), default=0)
    # unique symbols: one ahead of all, one after each text
    parts = [np.array([words], np.int64)]
    for k, t in enumerate(texts):
        parts += [t, np.array([words + 1 + k], np.int64)]
    symbols = np.concatenate(parts)
    begin = np.cumsum(sizes + 1) - sizes
    period, at, last = _stretches(symbols, int(sizes.max(initial=0)))
    found = []
    if len(period):
        levels = grammar(symbols)
        mirrored = [level.mirrored() for level in levels]
        n = len(symbols)
    while len(period):
        for k in range(0, len(period), STEP):
            q, i = period[k:k + STEP], at[k:k + STEP] * period[k:k + STEP]
            end = i + q + extensions(levels, i, i + q)
            start = i - extensions(mirrored, n - i, n - i - q)
            run = end - start >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
            found.append(np.stack([start[run], end[run] - start[run], q[run]], axis=1))
            # the next multiple whose pair isn't inside this extension
            at[k:k + STEP] = np.maximum(at[k:k + STEP] + 1, -((q - end) // q))
        more = at <= last
        period, at, last = period[more], at[more], last[more]
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = np.searchsorted(begin, rows[:, 0], "right") - 1
    rows[:, 0] -= begin[of]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _done(batches, column: str, schema: pa.Schema):
    kind = schema.field("runs").type

    def batch_of(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict(count().__next__)
        found = find_runs([np.array([*map(number.__getitem__, words)], np.int64) for words in texts])
        kept = [b" ".join(_collapsed(words, runs) if len(runs) else words) for words, runs in zip(texts, found, strict=True)]
        # rows of three longs are a list of structs
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
        items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        added = {"n_words": pa.array([len(w) for w in texts], pa.int64()), "runs": pa.ListArray.from_arrays(offsets, items).cast(kind),
                 "collapsed": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.RecordBatch.from_arrays([added[f.name] if f.name in added else part.column(f.name) for f in schema], schema=schema)

    for batch in batches:
        held, words, first = [], 0, 0
        for k, text in enumerate(as_bytes(batch.column(column))):
            own = [w for w in text.translate(SPACES).split(b" ") if w] if text else []
            if held and words + len(own) > BATCH_WORDS:
                yield batch_of(batch.slice(first, k - first), held)
                held, words, first = [], 0, k
            held.append(own)
            words += len(own)
        if held:
            yield batch_of(batch.slice(first), held)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period; word numbers from
    0) and ``collapsed``: the words that no run holds after its first period, joined by one space."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    docs = docs.withColumn("collapsed", F.col(text).cast("string")).select(*kept, F.lit(0).cast("bigint").alias("n_words"),
                                                                            F.lit(None).cast(RUNS).alias("runs"), "collapsed")
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(lambda batches: _done(batches, "collapsed", arrow), schema)
