"""Mixing sources to target weights by a splitting tree.

A source's documents, in the order of a hash of id and text, are one stream of
words, cut into blocks of ``BLOCK`` words. Blocks are permuted by a Feistel
network; a source's draws are the first places of its permutation, and further
permutations of all its blocks where it is repeated. So a quota of words is
met exactly: whole blocks, and a part of the last one.

The quotas, one number of blocks a source, are dealt to output shards by a binary
tree. At each node the left half's share of every source is drawn from the
multivariate hypergeometric distribution, seeded by the node, so that any task finds
the shard of any draw from the seed alone, and the shards' exact quotas add up to
the sources'. Draws of a source are numbered from shard to shard, so shards hold
disjoint draws. Pieces go to their shard and are shuffled there by block.

Places in a stream come from sums of parts: a source is dealt to parts of about
``PART_WORDS`` words by the hash, their sums are added up, and documents are placed in
their part, so a source may hold any share of the corpus.

Defined cases: a null or empty text has no words and no pieces; a null source is a
source, ranked last; sources are taken as strings; repeated rows are separate documents, and null ids
are ids; an empty table gives an empty mix; only id, source and text are read; a long text is
cut like others. The same rows give the same mix in any order or layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_bytes, cut

#: Weights of the sources by rank, repeating; a source is taken this many times at most.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block, blocks of a shard, words of a part.
BLOCK, SHARD_BLOCKS, PART_WORDS = 256, 1 << 13, 1 << 20
#: Sources that a plan, which driver and tasks hold, may have; more are an error.
MAX_SOURCES = 1 << 16
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


# --- targets and quotas ---


def targets(sizes: list[int], weights: list[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight; those above ``repeats`` times their size
    stop there, and the excess is shared again by weight until none is above."""
    found, left, open_ = [0.0] * len(sizes), float(total), list(range(len(sizes)))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                found[i] = each * weights[i]
            break
        for i in full:
            found[i] = float(repeats * sizes[i])
            left -= found[i]
        open_ = [i for i in open_ if i not in set(full)]
    return found


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1: a Feistel network over an even number of
    bits, walked on until the place is below ``n``."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & low
        for turn in range(4):
            a, b = b, a ^ _mixed(b, key * 8 + turn) & low
        out[todo] = a << half | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Per source, in the order of their ranks: name, ``size`` (words),
    ``target``, ``blocks`` of its stream, ``draws``, and the words ``last``
    that its last draw takes (0: without draws)."""

    names: tuple
    size: tuple
    target: tuple
    blocks: tuple
    draws: tuple
    last: tuple
    block: int
    shards: int
    seed: int


def plan(sizes: dict, weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS, block: int = BLOCK,
         shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> Plan:
    """Of sources and their sizes; ``share`` is the mix's part of all words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    size = [sizes[s] for s in names]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))], share * sum(size), repeats)
    blocks, draws, last = [], [], []
    for s, (words, goal) in enumerate(zip(size, target, strict=True)):
        quota, n = min(round(goal), repeats * words), -(-words // block)
        blocks.append(n)
        if not quota:
            draws.append(0)
            last.append(0)
            continue
        whole, rest = divmod(quota, words)
        if not rest:
            whole, rest = whole - 1, words
        # the stream's last block is shorter; where the permutation has it decides how many blocks make up the rest
        short_at = int(permuted(np.array([n - 1]), n, _key(seed, s, whole))[0])
        missing = n * block - words
        held = lambda m: m * block - (missing if short_at < m else 0)  # noqa: E731, B023
        m = -(-rest // block)
        while held(m) < rest:
            m += 1
        draws.append(whole * n + m)
        last.append(rest - held(m - 1))
    shards = max(1, -(-sum(draws) // shard_blocks))
    return Plan(tuple(names), tuple(size), tuple(target), tuple(blocks), tuple(draws), tuple(last), block, shards, seed)


def _key(seed: int, source: int, epoch: int) -> int:
    return ((seed << 20) + source << 8) + epoch


# --- the tree ---


def hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement fall on each colour, for
    counts of any size: binomial numbers first, whose sum misses ``n`` by about its root;
    the surplus is drawn back out, or the lack drawn from what is left, in the same way."""
    total = int(counts.sum())
    if 2 * n > total:
        return counts - hypergeometric(rng, counts, total - n)
    if n <= 32:
        out, left = np.zeros_like(counts), counts.copy()
        for _ in range(n):
            at = np.searchsorted(np.cumsum(left), rng.integers(int(left.sum())), "right")
            out[at] += 1
            left[at] -= 1
        return out
    out = rng.binomial(counts, n / total)
    lack = n - int(out.sum())
    return out + hypergeometric(rng, counts - out, lack) if lack >= 0 else out - hypergeometric(rng, out, -lack)


def _until(total: int, shards: int, shard: int) -> int:
    """Draws of the shards before ``shard``."""
    return total * shard // shards


@lru_cache(maxsize=1 << 16)
def _left(root: Plan, low: int, high: int, counts: tuple) -> np.ndarray:
    """The left half's draws of each source at the node of shards ``low`` to ``high``."""
    total, middle = sum(root.draws), (low + high) // 2
    n = _until(total, root.shards, middle) - _until(total, root.shards, low)
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([root.seed, low, high])))
    return hypergeometric(rng, np.array(counts, np.int64), n)


def shard_quotas(root: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of each source in a shard."""
    low, high, first, counts = 0, root.shards, np.zeros(len(root.draws), np.int64), np.array(root.draws, np.int64)
    while high - low > 1:
        left, middle = _left(root, low, high, tuple(counts.tolist())), (low + high) // 2
        if shard < middle:
            high, counts = middle, left
        else:
            low, first, counts = middle, first + left, counts - left
    return first, counts


def shards_of(root: Plan, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The shard of each draw (source, number), by descending the tree."""
    out = np.zeros(len(draw), np.int64)
    todo = [(0, root.shards, np.arange(len(draw)), draw, np.array(root.draws, np.int64))]
    while todo:
        low, high, at, number, counts = todo.pop()
        if high - low == 1:
            out[at] = low
        elif len(at):
            left, middle = _left(root, low, high, tuple(counts.tolist())), (low + high) // 2
            first = number < left[source[at]]
            todo.append((low, middle, at[first], number[first], left))
            todo.append((middle, high, at[~first], (number - left[source[at]])[~first], counts - left))
    return out


def shard_table(spark, root: Plan) -> DataFrame:
    """``(shard, source, first, draws)``: the exact quota of every shard with draws of a source."""
    def rows(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_quotas(root, shard)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(at), shard), "source": pa.array([root.names[s] for s in at], pa.string()),
                                                  "first": first[at], "draws": counts[at]})

    return spark.range(root.shards).mapInArrow(rows, "shard bigint, source string, first bigint, draws bigint")


# --- places and pieces ---


def _ordered(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """``(doc_id, source, text, size, h, h2)``; the hashes order a source's stream."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"),
                       word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text)).alias("h"),
                       F.xxhash64(F.col(text), F.col(doc_id)).alias("h2"))


def _part(words_of_source: Column, part_words: int) -> Column:
    """Number of the part of the stream that a hash falls in, parts in hash order."""
    parts = F.ceil(words_of_source / part_words)
    # 2^32 steps of the hash's upper half, from the least
    return F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)).cast("bigint")


class Mix:
    """A plan for ``docs``: ``documents``, every row with its place and its
    source's ``size`` and ``target``, ``pieces``, the shuffled shards, and ``shards``, their quotas."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = 1.0, doc_id: str = "doc_id", text: str = "text",
                 source: str = "source", repeats: int = REPEATS, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS,
                 part_words: int = PART_WORDS, seed: int = SEED):
        self._rows, self._part_words = _ordered(docs, doc_id, text, source), part_words
        self._light = cut(self._rows.drop("text"))
        sums = self._light.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(sums) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.plan = plan({r.source: r["size"] for r in sums}, weights, share, repeats, block, shard_blocks, seed)
        p = self.plan
        rows = [(n, i, s, t) for i, (n, s, t) in enumerate(zip(p.names, p.size, p.target, strict=True))]
        # MAX_SOURCES rows at most
        self._sources = F.broadcast(docs.sparkSession.createDataFrame(rows, "name string, s int, source_size bigint, target double"))
        parts = self._parted(self._light).groupBy("s", "part").agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self._before = cut(parts.select("s", "part", before.alias("before")))

    def _parted(self, rows: DataFrame) -> DataFrame:
        named = rows.join(self._sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        return named.withColumn("part", _part(F.col("source_size"), self._part_words))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With ``start``: words of the source's stream ahead of the document."""
        parted = self._parted(rows.where("size > 0"))
        inside = Window.partitionBy("s", "part").orderBy("h", "doc_id", "h2").rowsBetween(Window.unboundedPreceding, -1)
        return (parted.join(self._before, ["s", "part"])
                .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("part", "before"))

    @property
    def documents(self) -> DataFrame:
        """``(doc_id, source, s, size, source_size, target, start)``; without words ``start`` is null."""
        columns = ["doc_id", "source", "s", "size", "source_size", "target", "start"]
        empty = self._parted(self._light.where("size = 0")).withColumn("start", F.lit(None).cast("bigint"))
        return self._placed(self._light).select(*columns).unionByName(empty.select(*columns))

    @property
    def pieces(self) -> DataFrame:
        """``(shard, place, source, s, start, doc_id, first_word, n_words, text)``, shard by
        shard: ``place`` orders a shard, ``first_word`` counts from 0 in the document, ``start`` is the document's place."""
        p, rows = self.plan, self._placed(self._rows).select("doc_id", "source", "s", "start", "size", "text")
        out = (f"shard bigint, place bigint, source string, s int, start bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
               "draw bigint, first_word bigint, n_words bigint, text string")
        drawn = rows.mapInArrow(lambda batches: _drawn(batches, p), out)
        return drawn.repartition("shard").sortWithinPartitions("shard", "place", "s", "draw", "start").drop("draw")

    @property
    def shards(self) -> DataFrame:
        return shard_table(self._rows.sparkSession, self.plan)


def _draws(p: Plan, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks (source, number) their draws: which of the blocks, the draws' numbers, and the words taken."""
    of, numbers, words = [], [], []
    for s in np.unique(source).tolist():
        at, n, total = np.flatnonzero(source == s), p.blocks[s], p.draws[s]
        for epoch in range(-(-total // n)):
            number = epoch * n + permuted(block[at], n, _key(p.seed, s, epoch))
            drawn = number < total
            of.append(at[drawn])
            numbers.append(number[drawn])
            words.append(np.where(number[drawn] == total - 1, p.last[s], p.block))
    if not of:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(of), np.concatenate(numbers), np.concatenate(words)


def _drawn(batches, p: Plan):
    for batch in batches:
        for begin in range(0, len(batch), 512):
            part = batch.slice(begin, 512)
            source, start, size = (part.column(c).to_numpy().astype(np.int64) for c in ("s", "start", "size"))
            first = start // p.block
            many = (start + size - 1) // p.block - first + 1
            row = np.repeat(np.arange(len(part)), many)
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row]
            of, draw, most = _draws(p, source[row], block)
            row, block = row[of], block[of]
            low = np.maximum(block * p.block - start[row], 0)
            high = np.minimum(block * p.block + most - start[row], size[row])
            # by document; a draw that takes part of its block may miss a document
            at = np.argsort(row, kind="stable")
            at = at[(high > low)[at]]
            row, draw, low, high = row[at], draw[at], low[at], high[at]
            if not len(row):
                continue
            texts = as_bytes(part.column("text"))
            a, b = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
            for i, j in zip(edges, edges[1:], strict=False):
                text = texts[row[i]]
                inside = np.frombuffer(b" " + text.translate(_SPACES) + b" ", np.uint8) != 32
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                a[i:j], b[i:j] = edge[2 * low[i:j]], edge[2 * high[i:j] - 1]
            cuts = [texts[r][x:y] for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True)]
            shard = shards_of(p, source[row], draw)
            place = _mixed(_mixed(draw.astype(np.uint64), p.seed + 1) ^ source[row].astype(np.uint64), p.seed + 2).view(np.int64)
            taken = part.select(["source", "s", "start", "doc_id"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(place), *taken.columns, pa.array(draw), pa.array(low),
                 pa.array(high - low), pa.array(cuts, pa.binary()).cast(pa.string())],
                ["shard", "place", "source", "s", "start", "doc_id", "draw", "first_word", "n_words", "text"])


def mix_digest(mix: Mix) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every document, ``taken`` from the pieces."""
    taken = mix.pieces.groupBy("s", "start").agg(F.sum("n_words").alias("taken"))
    return mix.documents.join(taken, ["s", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
