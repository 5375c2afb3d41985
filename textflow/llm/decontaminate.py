"""Benchmark decontamination by one Aho-Corasick automaton.

Every window of ``window`` consecutive words of a benchmark item is a pattern
(an item of fewer words, but not none, is one pattern). Texts are lower-cased
(A-Z), their words joined by single spaces, and scanned once; the places found
are mapped back to word numbers and byte offsets of the original text.

A benchmark too large for one automaton is split by item. Its automata are used in
jobs of their own, one after the other, so that a worker never holds two.

Defined cases: a null or empty text has no words and no hits; an item without
words has no pattern; repeated items and items that share windows are all
reported; an empty benchmark table hits nothing. Item ids are compared as
strings; a null item id takes part under no name (its windows count as hits).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_WORDS, as_bytes, cut

WINDOW = 10
#: Text of the items in one automaton, which every task holds: a window starts at each
#: word, so an automaton takes about 400 bytes for a byte of text. A larger
#: benchmark is split by item into several automata, and texts are scanned by each.
MAX_AUTOMATON_BYTES = 512 << 10

ROW = "__decontaminated_row"
HITS = "n_words bigint, words array<int>, items array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"


def item_groups(items: DataFrame, item_id: str = "item_id", text: str = "text",
                most: int = MAX_AUTOMATON_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """The items in groups of about ``most`` bytes of text, read to the driver
    one group at a time (a group is as large as its largest item at least)."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + held // most
    of = F.pmod(F.xxhash64("id", "text"), F.lit(groups))
    for g in range(groups):
        yield [(r.id, r.text) for r in (rows.where(of == g) if groups > 1 else rows).collect()]


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_WORDS).split() if text else []


def windows(items: list[tuple[str | None, str]], window: int) -> dict[str, list[str]]:
    """Pattern -> ids of the items that hold it. Patterns start and end with a
    space; bytes are written as Latin-1 characters."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = _words(text.encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            pattern = b" %s " % b" ".join(words[i:i + window])
            found.setdefault(pattern.decode("latin-1"), set()).update([item] if item is not None else [])
    return {p: sorted(ids) for p, ids in found.items()}


def _automaton(patterns: dict[str, list[str]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p, ids in patterns.items():
        automaton.add_word(p, (len(p), ids))
    automaton.make_automaton()
    return automaton


def _starts(words: list[bytes]) -> np.ndarray:
    """Offsets of the words in their text joined by spaces, one space ahead."""
    return np.cumsum([1, *map(len, words)], dtype=np.int64) + np.arange(len(words) + 1)


def _original(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word as byte offsets of the original text."""
    inside = np.frombuffer(b" " + text.translate(ASCII_WORDS) + b" ", np.uint8) != 32
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def scan(text: bytes | None, automaton) -> dict:
    words = _words(text)
    out = {"n_words": len(words), "words": [], "items": [], "spans": []}
    if not words or not len(automaton):
        return out
    line = b" %s " % b" ".join(words)
    places = {}
    for end, (length, ids) in automaton.iter(line.decode("latin-1")):
        places[end - length + 2, end] = ids  # first letter and the space after the last
    if not places:
        return out
    starts = _starts(words)
    edges = np.zeros(len(words) + 1, np.int64)
    first = np.searchsorted(starts, [s for s, _ in places])
    last = np.searchsorted(starts, [e for _, e in places])  # the word after the last
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    hit = np.flatnonzero(np.cumsum(edges[:-1]))
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    begin, stop = _original(text)
    out["words"] = hit.tolist()
    out["items"] = sorted(set().union(*places.values()))
    out["spans"] = [{"first": int(r[0]), "last": int(r[-1]), "start": int(begin[r[0]]), "end": int(stop[r[-1]])}
                    for r in runs]
    return out


def _hits(text: Column, items: list[tuple[str | None, str]], window: int) -> Column:
    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(windows(items, window))
        kind = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")])))])
        for batch in batches:
            yield pa.array([scan(t, automaton) for t in as_bytes(batch)], kind)

    return hits.asNondeterministic()(text)


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "hits", window: int = WINDOW,
              item_id: str = "item_id", item_text: str = "text", most: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a struct ``out`` (replacing a column of that name):
    ``n_words``; ``words``, the numbers of the words inside any window;
    ``items``, the ids of the items found; ``spans``, maximal runs of hit words
    as word numbers and byte offsets (``end`` exclusive). With several automata,
    ``docs`` and what each finds are written to the shared folder; finds are joined by row and
    their runs merged, so that the number of automata doesn't show."""
    groups = item_groups(items, item_id, item_text, most)
    first, second = next(groups), next(groups, None)
    if second is None:
        return docs.withColumn(out, _hits(F.col(text), first, window))
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = None
    for items_of in chain([first, second], groups):
        part = rows.select(ROW, _hits(F.col(text), items_of, window).alias("h")).select(ROW, "h.*")
        # the first part has every row, for its number of words
        part = cut(part if found is None else part.where(F.size("words") > 0))
        found = part if found is None else found.unionByName(part)
    all_of = lambda field: F.array_sort(F.array_distinct(F.flatten(F.collect_list(field)))).alias(field)
    joined = found.groupBy(ROW).agg(F.max("n_words").alias("n_words"), *[all_of(f) for f in ("words", "items", "spans")]).select(
        ROW, F.struct("n_words", "words", "items", _merged(F.col("spans")).alias("spans")).alias(out))
    return rows.drop(out).join(joined, ROW).drop(ROW)


def _merged(spans: Column) -> Column:
    """Sorted spans, of which those that overlap or touch become one."""
    last = lambda done: F.element_at(done, -1)
    both = lambda a, b: F.struct(
        a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))
    joins = lambda done, s: (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1)["last"], F.lit(-2)) >= s["first"] - 1)
    step = lambda done, s: F.when(joins(done, s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both(last(done), s)))
                                  ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.filter(spans, lambda _: F.lit(False)), step)


def oracle_sql(window: int = WINDOW) -> str:
    """The digest of op9 over ``documents`` and ``benchmark`` in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[k:k + {window} - 1], ' ') AS pattern
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
g AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS pattern
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT r, k, n, item_id FROM g JOIN p USING (n, pattern)),
hit AS (SELECT r, count(DISTINCT at_word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS at_word FROM h) GROUP BY r),
f AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN f USING (r)"""
