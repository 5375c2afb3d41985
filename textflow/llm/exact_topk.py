"""Exact top-k search by pivot-table elimination.

Vectors are scaled to integers. A table holds their Euclidean distances to
``PIVOTS`` pivots. For a query q and a candidate x the largest difference of
their distances to a pivot is a lower bound L of their distance, so their
inner product is at most (|q|^2 + |x|^2 - L^2) / 2. Candidates are evaluated
in the order of this bound until the next one cannot reach the k-th best
score; the results are exact.

Candidates are packed into blocks of those nearest to one pivot, and a block keeps its
least and largest distance to each pivot. Queries, a stated set, are taken in groups of
bounded size, which go to the candidates; no candidate moves for a query. A group is searched twice: first
each query in the blocks of its own pivot, which gives it a k-th score, then in the other blocks
whose bound reaches that score; a block that no query of the group reaches is left out before its
vectors are handed on.

Defined cases: a vector that is null, or holds a null or non-finite component,
takes no part. Vectors whose squared length once scaled is beyond ``MAX_SQUARED`` are
evaluated without elimination, in whole numbers of any size; a pair whose score is
beyond a long, the type of the scores, has none and is left out. The product of two others is at most that of their lengths,
so every score is exact. Vectors are compared with those of
the same length (of length 0 every score is 0). Null ids take no part.
Rows with a query's id are not its candidates, other repeated ids are separate
ones; a query row that repeats is one query, two vectors of one id are two; a
query without candidates has no rows; ties go to the smaller id; extra columns play no part.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, gathered, groups, scratch_dir

SCALE = 256
PIVOTS = 32
#: Rows that pivots are chosen from, by a hash of their vector.
PIVOT_SAMPLE = 1024
#: Rows of a block of candidates; queries of a group, and the bytes of their vectors.
BLOCK, QUERY_BLOCK, QUERY_BYTES = 2048, 1 << 16, 64 << 20
#: Squared length of a scaled vector: below 2^63, with room for rounding.
MAX_SQUARED = 9.2e18
#: Beyond this once scaled the SQL leaves a vector out; the operator keeps it.
MAX_COMPONENT = 1 << 60
_STEP = 256
_LONG = 1 << 63


def scaled(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(id, v array<double>, dim, wide)`` of the rows that take part: scaled
    whole numbers, or, where ``wide``, the components as they are."""
    x = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
            .select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(finite))
    whole = F.transform("x", lambda c: c * float(SCALE))
    squared = F.aggregate(whole, F.lit(0.0), lambda total, c: total + c * c)
    rows = rows.withColumn("wide", F.aggregate("x", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c))) > 1e100)
    rows = rows.withColumn("wide", F.when(F.col("wide"), True).otherwise(squared > MAX_SQUARED))
    # floor of a double is a long in Spark, which the components of rows that aren't wide fit in
    narrow = F.transform("x", lambda c: F.floor(c * float(SCALE)).cast("double"))
    return rows.select("id", F.when(F.col("wide"), F.col("x")).otherwise(narrow).alias("v"), F.size("x").alias("dim"), "wide")


def _whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite double."""
    return int(np.floor(x * SCALE)) if abs(x) < 1 << 53 else int(x) * SCALE


def choose_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """Pivots of each dimension: of a bounded sample, always the row farthest
    from those chosen. Any choice gives exact results."""
    found, rows = {}, rows.where("not wide")
    for (dim,) in rows.select("dim").distinct().limit(64).collect():  # of further dimensions none: bounds by norm alone
        if not dim:
            continue
        drawn = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()
        v = np.array([r.v for r in drawn], np.float64)
        chosen, far = [0], np.linalg.norm(v - v[0], axis=1)
        while len(chosen) < min(count, len(v)):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, np.linalg.norm(v - v[chosen[-1]], axis=1))
        found[dim] = v[chosen]
    return found


def _far(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    if not len(to):
        return np.zeros((len(v), 0))
    return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in to], axis=1)


def _packed(rows: DataFrame, size: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(dim, wide, pivot, ids, v, far, low, high, most)``: blocks of about ``size`` rows nearest to
    one pivot, with their vectors and distances as bytes, the extremes of the distances, and the largest squared length."""
    def nearest(batches):
        for batch in batches:
            v, dim, wide = batch.column("v"), batch.column("dim").to_numpy(), batch.column("wide").to_pylist()
            pivot = np.full(len(dim), -1, np.int64)
            flat, offsets = v.flatten().to_numpy(), np.cumsum([0, *dim.tolist()])
            for d, to in pivots.items():
                at = np.array([i for i in np.flatnonzero(dim == d).tolist() if not wide[i]], np.int64)
                if len(at):
                    pivot[at] = _far(flat[offsets[at][:, None] + np.arange(d)], to).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], [*batch.schema.names, "pivot"])

    # written, as it is read to count its clusters and to deal them to blocks
    near = cut(rows.mapInArrow(nearest, "id bigint, v array<double>, dim int, wide boolean, pivot bigint"))
    cluster = ["dim", "wide", "pivot"]
    counts = F.broadcast(near.groupBy(*cluster).agg(F.ceil(F.count("*") / size).cast("long").alias("parts")))
    part = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    placed = near.join(counts, cluster).withColumn("key", F.xxhash64(*cluster, part))

    def pack(batches):
        for table in groups(batches, "key"):
            # two clusters of one key would be two blocks
            names = list(zip(*[table.column(c).to_pylist() for c in cluster], strict=True))
            for name in dict.fromkeys(names):
                own = table if len(set(names)) == 1 else table.filter(pa.array([n == name for n in names]))
                dim, wide, pivot = name
                ids = own.column("id").to_numpy()
                v = own.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
                far = np.zeros((len(ids), 0)) if wide else _far(v, pivots.get(dim, np.zeros((0, dim))))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim], pa.int32()), "wide": [wide], "pivot": pa.array([pivot], pa.int64()),
                    "ids": [ids.astype(np.int64).tobytes()], "v": [v.astype(np.float64).tobytes()], "far": [far.tobytes()],
                    "low": pa.array([far.min(axis=0).tolist()], pa.list_(pa.float64())),
                    "high": pa.array([far.max(axis=0).tolist()], pa.list_(pa.float64())),
                    "most": [0.0 if wide else float((v * v).sum(axis=1).max(initial=0))]})

    kept = gathered(placed.select("key", *cluster, "id", "v"), "key")
    return kept.mapInArrow(pack, "dim int, wide boolean, pivot bigint, ids binary, v binary, far binary, "
                                 "low array<double>, high array<double>, most double")


def _best(query, query_far, candidates, candidate_ids, candidate_far, norms, own_id, best, k, least):
    """``best`` (scores, ids) with the candidates of a block taken in; scores below ``least`` aren't needed."""
    norm = float(query @ query)
    low = np.abs(candidate_far - query_far).max(axis=1, initial=0.0)
    # rounding of the distances and norms is far below this slack
    bound = (norm + norms - np.maximum(low - 1e-6 * (1 + low), 0) ** 2) / 2 + 1 + 1e-9 * (norm + norms)
    order = np.argsort(-bound, kind="stable")
    scores, ids = best
    for i in range(0, len(order), _STEP):
        if bound[order[i]] < (max(least, scores[-1]) if len(scores) == k else least):
            break
        part = order[i:i + _STEP]
        part = part[candidate_ids[part] != own_id]
        scores = np.concatenate([scores, candidates[part] @ query])
        ids = np.concatenate([ids, candidate_ids[part]])
        top = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[top], ids[top]
    return scores, ids


class Group:
    """The queries of a group with vectors of one length."""

    def __init__(self, dim: int, rows: list[tuple], pivots: dict[int, np.ndarray], wide: bool):
        self.dim, self.wide, self.at, self.ids = dim, wide, np.array([r[0] for r in rows]), [r[1] for r in rows]
        if wide:
            self.v = [np.array([_whole(x) for x in r[2]], object) for r in rows]
            return
        v = np.array([r[2] for r in rows], np.float64).reshape(len(rows), dim)
        self.v, self.far, self.norms = v.astype(np.int64), _far(v, pivots.get(dim, np.zeros((0, dim)))), (v * v).sum(axis=1)
        self.pivot = self.far.argmin(axis=1) if self.far.shape[1] else np.full(len(rows), -1)

    def reached(self, low: np.ndarray, high: np.ndarray, most: float, least: np.ndarray) -> np.ndarray:
        """Which queries a block may have a score of ``least`` for."""
        gap = np.maximum(np.maximum(self.far - high, low - self.far), 0).max(axis=1, initial=0.0)
        gap = np.maximum(gap - 1e-6 * (1 + self.far.max(axis=1, initial=0.0) + high.max(initial=0.0)), 0)
        length = np.sqrt(self.norms * most)
        bound = np.minimum((self.norms + most - gap ** 2) / 2, length) + 1 + 1e-9 * (self.norms + most)
        return bound >= least[self.at]


def _grouped(asked: DataFrame) -> int:
    """Number of groups, so that each is about ``QUERY_BLOCK`` queries and ``QUERY_BYTES`` at most."""
    n, items = asked.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    return max(1, -(-n // QUERY_BLOCK), -(-8 * items // QUERY_BYTES))


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its
    ``k`` best rows of ``vectors`` by integer inner product, its own id left out."""
    rows = cut(scaled(vectors, vec_id, vector))
    asked = cut(scaled(queries, vec_id, vector).distinct())
    pivots = choose_pivots(rows)
    blocks = cut(_packed(rows, BLOCK, pivots))
    n = _grouped(asked)
    part, folder = F.pmod(F.xxhash64("id", "v"), F.lit(n)), f"{scratch_dir(vectors.sparkSession)}/{uuid.uuid4().hex}"
    for g in range(n):
        # a group is bounded by QUERY_BLOCK and QUERY_BYTES
        own = sorted((r.id, r.v, r.wide) for r in asked.where(part == g).select("id", "v", "wide").collect())
        _search_group(blocks, own, pivots, k).write.parquet(f"{folder}/{g}")
    found = vectors.sparkSession.read.parquet(*[f"{folder}/{g}" for g in range(n)])
    return found.select("query_id", "rank", "vec_id", "score")


def _search_group(blocks: DataFrame, own: list[tuple], pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    parted: dict[tuple, list] = {}
    for at, (i, v, wide) in enumerate(own):
        parted.setdefault((len(v), wide), []).append((at, i, v))
    asked = [Group(dim, rows, pivots, wide) for (dim, wide), rows in parted.items()]

    def evaluate(batches, least, home):
        best = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["v"], np.float64).reshape(len(ids), dim)
                low, high = np.array(row["low"]), np.array(row["high"])
                norms, whole = (v * v).sum(axis=1), None if row["wide"] else v.astype(np.int64)
                far = np.frombuffer(row["far"], np.float64).reshape(len(ids), -1) if dim and row["far"] else np.zeros((len(ids), 0))
                for group in asked:
                    if group.dim != dim:
                        continue
                    if group.wide or row["wide"]:
                        if not home:
                            _any_size(group, ids, v, row["wide"], best, k)
                        continue
                    own_pivot = (group.pivot == row["pivot"]) if home else np.ones(len(group.at), bool)
                    for i in np.flatnonzero(own_pivot & group.reached(low, high, row["most"], least)):
                        at = int(group.at[i])
                        best[at] = _best(group.v[i], group.far[i], whole, ids, far, norms, group.ids[i], best.get(at, _NONE), k, least[at])
        yield from _rows(best)

    def _rows(best):
        best = {at: b for at, b in best.items() if len(b[0])}
        if best:
            yield pa.RecordBatch.from_pydict({
                "q": np.repeat(np.array(list(best), np.int32), [len(s) for s, _ in best.values()]),
                "vec_id": np.concatenate([i for _, i in best.values()]), "score": np.concatenate([s for s, _ in best.values()])})

    def run(least, home, table):
        found = table.mapInArrow(lambda batches: evaluate(batches, least, home), "q int, vec_id bigint, score bigint")
        # k rows of each query and task: collected per query, bounded by k times the tasks
        return found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))

    least = np.full(len(own), -np.inf)
    any_pivot = sorted({int(p) for g in asked if not g.wide for p in g.pivot})
    for r in run(least, True, blocks.where(F.col("pivot").isin(any_pivot) & ~F.col("wide"))).where(F.size("best") == k).collect():
        least[r.q] = -r.best[-1].s

    @F.arrow_udf("boolean")
    def some(dim: pa.Array, wide: pa.Array, low: pa.Array, high: pa.Array, most: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in (dim, wide, low, high, most)], strict=True)
        return pa.array([any(g.dim == d and (w or g.wide or bool(g.reached(np.array(lo), np.array(hi), m, least).any())) for g in asked)
                         for d, w, lo, hi, m in rows], pa.bool_())

    reached = blocks.where(some("dim", "wide", "low", "high", "most"))
    names = F.broadcast(blocks.sparkSession.createDataFrame([(at, i) for at, (i, *_) in enumerate(own)], "q int, query_id bigint"))
    return (run(least, False, reached).select("q", F.posexplode("best").alias("rank", "b")).join(names, "q")
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")))


_NONE = np.empty(0, np.int64), np.empty(0, np.int64)


def _any_size(group: Group, ids: np.ndarray, v: np.ndarray, wide: bool, best: dict, k: int) -> None:
    """Scores in whole numbers of any size; those beyond a long are left out."""
    whole = np.array([[_whole(x) if wide else int(x) for x in r] for r in v.tolist()], object).reshape(v.shape)
    for at, own, query in zip(group.at.tolist(), group.ids, group.v, strict=True):
        query = query if group.wide else np.array([int(x) for x in query], object)
        scores = [sum(a * b for a, b in zip(r, query, strict=True)) for r in whole]
        fits = [(s, i) for s, i in zip(scores, ids.tolist(), strict=True) if -_LONG <= s < _LONG and i != own]
        held, held_ids = best.get(at, _NONE)
        both = sorted([(-s, i) for s, i in fits] + [(-s, i) for s, i in zip(held.tolist(), held_ids.tolist(), strict=True)])[:k]
        best[at] = np.array([-s for s, _ in both], np.int64), np.array([i for _, i in both], np.int64)


def oracle_sql(every: int, k: int) -> str:
    """The same over ``embeddings`` in DuckDB, for queries whose id is divisible by ``every``."""
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs({SCALE} * x::DOUBLE) > {MAX_COMPONENT})) = 0),
c AS (SELECT r, vec_id, len(v) AS dim, unnest(range(len(v))) AS i, unnest(v) AS x FROM e),
s AS (SELECT a.r, a.vec_id AS query_id, b.r AS other, b.vec_id, sum(a.x * b.x) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0 GROUP BY ALL
  HAVING sum(a.x * b.x) BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM t WHERE rank <= {k}"""
