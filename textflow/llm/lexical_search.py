"""Ranked lexical search with per-term geometric blocking.

Documents are read into segments of bounded size. In a segment every query
term has a posting list, and each list is cut into blocks of similar
documents: a sketch of every document's term weights (signed random projection)
is compared with those of a few documents of the list, one for ``BLOCK``
postings, and a posting goes to the nearest. A block's summary holds the
largest weight of each term in its documents, coordinate by coordinate.

Terms are ranked, rarest first, and lists are searched in that order. A
document is found in the list of its rarest query term, so a list's summaries
need no rarer terms, and none that share no query with it. The product of
query and summary bounds the scores of such documents exactly; a block is
skipped if its bound is below the query's k-th best score so far, which is carried from
segment to segment of a task, and all documents of other blocks are scored.

Scores are whole numbers. Sums beyond 2^53, which a double would round, are an error.

Queries are a stated set, held by the driver and the tasks: a set with more
terms than ``MAX_TERMS`` is searched in groups of queries, pass by pass.

Defined cases: a null or empty text has no terms, isn't counted and isn't found;
a query without terms has no rows; repeated queries and documents are separate ones;
null document ids rank behind others; an empty table finds nothing; columns beyond id
and text play no part; a very long text is one document, whose scan needs memory for its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ASCII_WORDS, as_bytes, cut

#: Postings of a block, about.
BLOCK = 64
#: Different terms of a group of queries, unless one query has more.
MAX_TERMS = 8192
#: Entries (terms times documents) of a segment, and its documents.
SEGMENT_ENTRIES, SEGMENT_DOCS = 1 << 24, 4096
#: Width of the sketches that documents are clustered by.
SKETCH = 16
#: Parts that the tasks' best rows are merged in before the last merge.
PARTS = 64
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_WORDS).split() if text else []


def query_groups(queries: DataFrame, query_id: str, text: str, most: int) -> list[list[tuple]]:
    """The queries with terms, in groups of ``most`` different terms: lists of (id, {term: times})."""
    groups, held = [[]], set()
    rows = queries.select(F.col(query_id).alias("id"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        times: dict[bytes, int] = {}
        for t in terms_of((row.text or "").encode()):
            times[t] = times.get(t, 0) + 1
        if not times:
            continue
        if held and len(held | set(times)) > most:
            groups.append([])
            held = set()
        held |= set(times)
        groups[-1].append((row.id, times))
    return groups


def _counted(batches, number: dict[bytes, int]):
    """Rows (id, n, terms, times): a document's terms, and which of ``number`` it holds how often."""
    for batch in batches:
        ids = batch.column("id")
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            n, terms, times = [], [], []
            for text in as_bytes(part.column("text")):
                words = terms_of(text)
                found = np.array([k for k in map(number.get, words) if k is not None], np.int32)
                own, often = np.unique(found, return_counts=True)
                n.append(len(words))
                terms.append(own)
                times.append(often)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, 256), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["id", "n", "terms", "times"])


def _frequencies(batches, width: int):
    df = np.zeros(width, np.int64)
    for batch in batches:
        df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "df": df[at]})


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def norms(n: pa.Array, n_docs: int, length: int) -> np.ndarray:
    """What a document's length counts against its terms (in Python's numbers, as 25 * n * N may pass 2^63)."""
    return 100 - 25 + np.array([25 * x * n_docs // length for x in n.to_pylist()], np.int64)


class Queries:
    """A group of queries by its terms, rarest first: ``matrix`` (queries,
    terms), and per term its ``asked`` queries and the ``columns`` of its
    summaries, itself and the less rare terms that a query has beside it."""

    def __init__(self, times: list[dict[int, int]], w: np.ndarray):
        self.order = np.argsort(-w, kind="stable")
        rank = np.empty(len(w), np.int64)
        rank[self.order] = np.arange(len(w))
        self.rank = rank
        self.matrix = np.zeros((len(times), len(w)))
        self.terms = []
        asked: list[list[int]] = [[] for _ in w]
        columns: list[set[int]] = [set() for _ in w]
        for q, own in enumerate(times):
            ranks = sorted(rank[t] for t in own)
            self.matrix[q, rank[list(own)]] = list(own.values())
            self.terms.append(np.array(ranks))
            for k, r in enumerate(ranks):
                asked[r].append(q)
                columns[r].update(ranks[k:])
        self.asked = [np.array(q, np.int64) for q in asked]
        self.columns = [np.array(sorted(c), np.int64) for c in columns]


def blocks_of(members: np.ndarray, sketch: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a posting list, block by block, and where blocks begin."""
    if len(members) <= block:
        return members, np.zeros(1, np.int64)
    near = np.argmax(sketch[members] @ sketch[members[::block]].T, axis=1)
    order = np.argsort(near, kind="stable")
    near = near[order]
    return members[order], np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1])


class Searcher:
    """The best rows of each query over the segments of a task; ``scored``
    and ``skipped`` count documents scored and blocks left out."""

    def __init__(self, queries: Queries, k: int, block: int):
        self.queries, self.k, self.block = queries, k, block
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries.terms]
        self.least = np.ones(len(queries.terms))  # a score counts from 1
        signs = np.random.default_rng(12).integers(0, 2, (queries.matrix.shape[1], SKETCH))
        self.signs = 2.0 * signs - 1
        self.scored = self.skipped = 0

    def segment(self, ids: np.ndarray, held: np.ndarray) -> None:
        """``held`` (terms by rank, documents) has the terms' weights in each document."""
        queries = self.queries
        norm = np.sqrt((held ** 2).sum(axis=0))
        sketch = (held.T @ self.signs) / np.maximum(norm, 1)[:, None]
        length = np.maximum(np.sqrt((sketch ** 2).sum(axis=1)), 1e-30)
        sketch /= length[:, None]
        seen = np.zeros((len(queries.terms), len(ids)), bool)
        for term in range(len(held)):
            asked, columns = queries.asked[term], queries.columns[term]
            members = np.flatnonzero(held[term])
            if not len(asked) or not len(members):
                continue
            members, begin = blocks_of(members, sketch, self.block)
            summary = np.maximum.reduceat(held[np.ix_(columns, members)], begin, axis=1)
            bound = queries.matrix[np.ix_(asked, columns)] @ summary
            reach = bound >= self.least[asked, None]
            self.skipped += int((~reach).sum())
            size = np.diff(begin, append=len(members))
            for row in np.flatnonzero(reach.any(axis=1)):
                q = asked[row]
                docs = members[np.repeat(reach[row], size)]
                docs = docs[~seen[q, docs]]
                if len(docs):
                    seen[q, docs] = True
                    self._score(q, docs, ids, held)

    def _score(self, q: int, docs: np.ndarray, ids: np.ndarray, held: np.ndarray) -> None:
        self.scored += len(docs)
        own = self.queries.terms[q]
        score = self.queries.matrix[q, own] @ held[np.ix_(own, docs)]
        if score.max() >= 1 << 53:
            raise ValueError("a score is beyond 2^53")
        good = score >= self.least[q]
        scores = np.concatenate([self.best[q][0], score[good].astype(np.int64)])
        found = np.concatenate([self.best[q][1], ids[docs[good]]])
        top = np.lexsort((found, -scores))[:self.k]
        self.best[q] = scores[top], found[top]
        if len(top) == self.k:
            self.least[q] = max(1, scores[top[-1]])


def _segments(batches, queries: Queries, w: np.ndarray, n_docs: int, length: int, entries: int, most: int):
    """The documents of a task: (ids, weights by rank and document) of each segment."""
    size = max(1, min(most, entries // max(1, len(w))))
    for batch in batches:
        for start in range(0, len(batch), size):
            part = batch.slice(start, size)
            ids = part.column("id").fill_null(_NO_ID).to_numpy()
            terms = part.column("terms")
            many = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(part)), many)
            term, tf = terms.flatten().to_numpy(), part.column("times").flatten().to_numpy()
            m = norms(part.column("n"), n_docs, length)
            held = np.zeros((len(w), len(part)))
            held[queries.rank[term], doc] = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            yield ids, held


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           query_id: str = "item_id", query_text: str = "text", max_terms: int = MAX_TERMS, block: int = BLOCK,
           entries: int = SEGMENT_ENTRIES, most: int = SEGMENT_DOCS) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: for each query the ``k`` documents
    of the highest scores above 0, equal ones by ascending id. A query's column keeps its name and
    type. ``doc_id`` is a whole number."""
    kind = queries.schema[query_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text <> ''")
    found = None
    for group in query_groups(queries, query_id, query_text, max_terms):
        part = _search_group(texts, group, k, block, entries, most, query_id, kind)
        found = part if found is None else found.unionByName(part)
    return found


def _search_group(texts: DataFrame, group: list[tuple], k: int, block: int, entries: int, most: int, query_id: str, kind: str) -> DataFrame:
    spark = texts.sparkSession
    number: dict[bytes, int] = {}
    times = [{number.setdefault(t, len(number)): c for t, c in own.items()} for _, own in group]
    counted = cut(texts.mapInArrow(lambda b: _counted(b, number), "id bigint, n bigint, terms array<int>, times array<bigint>"))
    n_docs, length = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = len(number)
    df = np.zeros(width, np.int64)
    # a row for each term of the group at most
    for row in (counted.select("terms").mapInArrow(lambda b: _frequencies(b, width), "term int, df bigint")
                .groupBy("term").agg(F.sum("df").alias("df")).collect()):
        df[row.term] = row.df
    w = weights(df, n_docs)
    asked = Queries(times, w)

    def best(batches):
        searcher = Searcher(asked, k, block)
        for ids, held in _segments(batches, asked, w, n_docs, length, entries, most):
            searcher.segment(ids, held)
        of = np.repeat(np.arange(len(times), dtype=np.int32), [len(s) for s, _ in searcher.best])
        if len(of):
            ids = np.concatenate([i for _, i in searcher.best])
            yield pa.RecordBatch.from_pydict({"q": of, "id": ids, "score": np.concatenate([s for s, _ in searcher.best])})

    rows = counted.where(F.size("terms") > 0).mapInArrow(best, "q int, id bigint, score bigint")
    # k rows of a query and task, merged in parts first
    rows = rows.withColumn("part", F.spark_partition_id() % PARTS)
    highest = [F.col("score").desc(), F.col("id").asc()]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*highest))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*highest))).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame([(q, own) for q, (own, _) in enumerate(group)], f"q int, `{query_id}` {kind}"))
    return rows.join(names, "q").select(query_id, F.col("rank").cast("int").alias("rank"),
                                        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "score")


def oracle_sql(k: int = 20) -> str:
    """The same over ``documents`` and ``benchmark`` in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT row_number() OVER () AS q, item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(w))::HUGEINT AS length FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM c) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs::DOUBLE + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * len(w)::HUGEINT * n_docs) // length)::BIGINT))) AS adds
      FROM p JOIN f USING (term) JOIN d USING (r), s),
t AS (SELECT q, r, sum(times * adds)::BIGINT AS score FROM c JOIN x USING (term) GROUP BY ALL HAVING sum(times * adds) > 0),
b AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM t JOIN d USING (r))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM b JOIN i USING (q) WHERE rank <= {k}"""
