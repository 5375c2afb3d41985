"""Mixing, ranked search and periodic runs: exactness, brute force, SQL, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.llm import lexical_search, mixing, periodic_runs, registry

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, s int, start bigint, runs string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- mixing ---


def test_targets_stop_at_three_sizes_and_share_the_excess():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 2010) == [30.0, 1320.0, 660.0]
    assert mixing.targets([0, 7], [5, 2], 7) == [0.0, 7.0]
    assert mixing.targets([], [], 0) == []
    assert mixing.targets([0, 0], [5, 2], 0) == [0.0, 0.0]


def test_permutation_is_one_and_mixes():
    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), n, 99)
        assert sorted(out.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 99).tolist() != mixing.permuted(np.arange(1000), 1000, 100).tolist()


def test_hypergeometric_draws_are_exact_and_unbiased():
    counts = np.array([600, 300, 0, 100])
    drawn = np.array([mixing.hypergeometric(np.random.default_rng(i), counts, 250) for i in range(800)])
    assert (drawn.sum(axis=1) == 250).all() and (drawn <= counts).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(axis=0), 250 * counts / 1000, atol=1)
    expected = 250 * counts / 1000 * (1 - counts / 1000) * (750 / 999)
    assert np.allclose(drawn.var(axis=0), expected, rtol=0.25)
    huge = np.array([10**13, 3 * 10**12])
    got = mixing.hypergeometric(np.random.default_rng(1), huge, 5 * 10**12)
    assert got.sum() == 5 * 10**12 and abs(got[0] / 5e12 - 10 / 13) < 1e-5


def test_shards_partition_the_quotas():
    root = mixing.plan({"a": 5000, "b": 900, None: 40, "c": 0}, block=7, shard_blocks=50)
    quotas = [mixing.shard_quotas(root, k) for k in range(root.shards)]
    assert root.shards > 8
    assert np.sum([c for _, c in quotas], axis=0).tolist() == list(root.draws)
    assert max(c.sum() for _, c in quotas) - min(c.sum() for _, c in quotas) <= 1
    for s, total in enumerate(root.draws):
        found = mixing.shards_of(root, np.full(total, s), np.arange(total))
        assert found.tolist() == [k for k, (first, c) in enumerate(quotas) for _ in range(c[s])]
        assert all(first[s] == sum(c[s] for _, c in quotas[:k]) for k, (first, _) in enumerate(quotas))


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = rng.choice(["hot"] * 6 + ["b", "é", None])
        text = rng.choice([" ", "\n\t "]).join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, text, source, 1, 2, "x"))
    return rows + [(1007, "same text", "b", 1, 2, "x")] * 5 + [(None, "no id here", "hot", 1, 2, "x"), (1008, None, None, 1, 2, "x")]


def test_mix_meets_quotas_with_real_pieces(spark, mixed_rows):
    docs = frame(spark, mixed_rows, DOCS)
    mix = mixing.Mix(docs, block=16, shard_blocks=40, part_words=500)
    pieces = mix.pieces.collect()
    texts = Counter((r[0], r[2]) for r in mixed_rows)
    words = {(r[0], r[2]): WORD.findall(r[1] or "") for r in mixed_rows}
    for p in pieces:
        own = words[p.doc_id, p.source][p.first_word:p.first_word + p.n_words]
        assert WORD.findall(p.text) == own and len(own) == p.n_words and p.text == p.text.strip()
    plan = mix.plan
    taken = Counter()
    for p in pieces:
        taken[p.source] += p.n_words
    for name, size, target in zip(plan.names, plan.size, plan.target, strict=True):
        assert taken[name] == min(round(target), 3 * size)
    assert plan.names[-1] is None and sum(plan.size) == sum(map(len, (WORD.findall(r[1] or "") for r in mixed_rows)))
    # a word of a document is taken as often as another, give or take one
    used = Counter()
    for p in pieces:
        for k in range(p.first_word, p.first_word + p.n_words):
            used[p.source, p.start, k] += 1
    for name, size, target in zip(plan.names, plan.size, plan.target, strict=True):
        times = [c for (s, *_), c in used.items() if s == name]
        if times:
            assert max(times) <= math.ceil(target / size) <= 3
    quotas = {(r.shard, r.source): r.draws for r in mix.shards.collect()}
    assert sum(quotas.values()) == sum(plan.draws) and {p.shard for p in pieces} == {s for s, _ in quotas}
    places = [p.place for p in pieces if p.shard == 0]
    assert places == sorted(places) and len({p.source for p in pieces if p.shard == 0}) > 1
    digest = mixing.mix_digest(mix).collect()
    assert Counter((r.doc_id, r.source) for r in digest) == texts
    assert all(0 <= r.taken <= 3 * r.size for r in digest) and sum(r.taken for r in digest) == sum(taken.values())


def test_mix_does_not_depend_on_layout(spark, mixed_rows):
    a = mixing.Mix(frame(spark, mixed_rows, DOCS).repartition(5), block=16, shard_blocks=40, part_words=500)
    b = mixing.Mix(frame(spark, mixed_rows[::-1], DOCS).coalesce(1), block=16, shard_blocks=40, part_words=500)
    columns = ["shard", "place", "source", "doc_id", "first_word", "n_words", "text"]
    assert Counter(a.pieces.select(columns).collect()) == Counter(b.pieces.select(columns).collect())


def test_mix_of_nothing(spark):
    empty = mixing.Mix(frame(spark, [], DOCS))
    assert empty.pieces.count() == 0 and mixing.mix_digest(empty).count() == 0
    blank = mixing.Mix(frame(spark, [(1, None, None, 1, 1, ""), (2, " ", "a", 1, 1, "")], DOCS))
    assert [(r.size, r.target, r.taken) for r in mixing.mix_digest(blank).collect()] == [(0, 0.0, 0)] * 2


def test_a_long_text_is_cut(spark):
    docs = frame(spark, [(1, "a b " * 100_000, "s", 1, 1, ""), (2, "c", "t", 1, 1, "")], DOCS)
    got = {r.doc_id: r for r in mixing.mix_digest(mixing.Mix(docs)).collect()}
    # t stops at three words, the rest is shared by the other source
    assert got[2].taken == 3 and got[1].taken == got[1].target == 200_001 - 3


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.Mix(frame(spark, [(i, "a", str(i), 1, 1, "") for i in range(3)], DOCS))


def test_op11_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = registry.op11_mix_sources(spark, SF001).collect()
    size = {d: len(WORD.findall(r.text)) for d, r in docs.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    names = sorted({r.source for r in docs.values()})
    totals = [sum(size[d] for d, r in docs.items() if r.source == s) for s in names]
    goal = dict(zip(names, mixing.targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(totals)), strict=True))
    taken = Counter()
    for r in rows:
        assert r.target == goal[docs[r.doc_id].source] and r.taken <= 3 * r["size"]
        taken[docs[r.doc_id].source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.op11_mix_sources(spark, SF001).collect()))


# --- ranked lexical search ---


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k):
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]
    held = [(d, lower(t)) for d, t in docs]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    rows = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 25 + 25 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in lower(text))
            if score > 0:
                scores.append((-score, d is None, d))
        rows += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return rows


@pytest.mark.parametrize("options", [{}, {"max_terms": 6, "block": 2, "most": 7}, {"block": 3, "entries": 200}])
def test_search_equals_brute_force(spark, options):
    rng = random.Random(2)
    word = lambda: "Wört" + str(min(int(rng.expovariate(0.2)), 40)) if rng.random() < 0.8 else rng.choice(["A", "b", "x-y", "É", "9"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(150)]
    docs += [(3, "A b")] * 2 + [(900 + i, "same wört1 words") for i in range(30)] + [(None, "same wört1 words"), (5, None), (6, "!!")]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(12, "same words words"), (12, "A"), (13, None), (14, "!"), (15, "nowhere")]
    table = frame(spark, [(*d, "s", 1, 1, "") for d in docs], DOCS)
    asked = frame(spark, [(*i, 1) for i in items], "item_id int, text string, score int")
    got = lexical_search.search(table.repartition(3), asked, 5, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0], r[1], -r[3], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(docs, items, 5), key=key)


def test_blocks_are_skipped_and_bounds_are_exact():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 1000, 60)
    queries = lexical_search.Queries([{int(t): 1 for t in rng.choice(60, 5, replace=False)} for _ in range(20)], w)
    held = np.where(rng.random((60, 2000)) < 0.1, rng.integers(1, 10**9, (60, 2000)), 0).astype(float)
    searcher = lexical_search.Searcher(queries, 10, 16)
    for part in np.split(np.arange(2000), 4):
        searcher.segment(part, held[:, part])
    for q in range(20):
        scores = (queries.matrix[q] @ held).astype(np.int64)
        top = np.lexsort((np.arange(2000), -scores))[:10]
        assert searcher.best[q][1].tolist() == top.tolist() and searcher.best[q][0].tolist() == scores[top].tolist()
    assert searcher.skipped > 0 and searcher.scored < 20 * (held > 0).any(axis=0).sum()


def test_search_of_nothing(spark):
    docs, items = frame(spark, [], DOCS), frame(spark, [(1, "a")], "item_id int, text string")
    assert lexical_search.search(docs, items).count() == 0
    some = frame(spark, [(1, "a b " * 50_000, "s", 1, 1, "")], DOCS)
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert lexical_search.search(some, items).count() == 1


def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF001}/{name}.parquet'")
    rows = registry.op12_lexical_search(spark, SF001)
    assert sorted(map(tuple, rows.collect())) == sorted(con.sql(f"select {', '.join(rows.columns)} from ({lexical_search.oracle_sql()})").fetchall())


# --- periodic runs ---


def runs_of(words):
    """By definition: for each period the stretches of equal words, smallest periods kept."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        k, end = 0, len(words) - q
        while k < end:
            first = k
            while k < end and words[k] == words[k + q]:
                k += 1
            if k - first + q >= max(24, 3 * q):
                best.setdefault((first, k - first + q), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    words, size = [], rng.choice([0, 5, 60, 300])
    while len(words) < size:
        letters = rng.choice([1, 2, 3, 40])
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
        words += part if rng.random() < 0.4 else (part * 160)[:rng.randint(1, 160)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        for words, found in zip(texts, periodic_runs.find_runs([np.array(w, np.int64) for w in texts]), strict=True):
            assert [tuple(r) for r in found.tolist()] == runs_of(words)


def test_runs_of_fibonacci_and_nested_periods():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    nested = (([1] * 30 + [2]) * 5 + [3]) * 4
    for words, found in zip((b, nested), periodic_runs.find_runs([np.array(b), np.array(nested)]), strict=True):
        assert [tuple(r) for r in found.tolist()] == runs_of(words) != []


def test_extensions_equal_comparison():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 30):
        s = np.concatenate([[letters], rng.integers(0, letters, 400), [letters + 1], np.tile(rng.integers(0, letters, 7), 30), [letters + 2]])
        levels = periodic_runs.grammar(s)
        i, j = rng.integers(0, len(s), (2, 500))
        i, j = i[i != j], j[i != j]
        got = periodic_runs.extensions(levels, i, j)
        for a, b, n in zip(i, j, got, strict=True):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert n == k


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_collapse_and_edges(spark, monkeypatch):
    texts = [None, "", " \n", "a " * 23, "a " * 24, "x\ty z\x0b" * 40 + "end", "é\x85b " * 30, "one two three"]
    docs = frame(spark, [(i, t, "s", 1, 1, "own") for i, t in enumerate(texts)] + [(4, "a " * 24, "s", 1, 1, "own")], DOCS)
    for most in (periodic_runs.BATCH_WORDS, 10):
        monkeypatch.setattr(periodic_runs, "BATCH_WORDS", most)
        out = periodic_runs.collapse_runs(docs)
        assert out.columns == ["doc_id", "text", "source", "s", "start", "n_words", "runs", "collapsed"]
        rows = out.collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            words = WORD.findall(r.text or "")
            runs = runs_of(words)
            assert r.text == texts[r.doc_id] and r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
            assert r.collapsed == " ".join(collapsed(words, runs))
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    long = frame(spark, [(1, "p q r " * 100_000, "s", 1, 1, "")], DOCS)
    assert periodic_runs.collapse_runs(long).first().collapsed == "p q r"


def test_op13_equals_brute_force(spark, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = registry.op13_periodic_runs(spark, SF001).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        words = WORD.findall(texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = runs_of(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(collapsed(words, runs)))


def test_op13_null_ids_and_texts(spark, tmp_path):
    frame(spark, [(None, "a " * 30), (1, None), (13, ""), (27, " "), (31, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and all(r.collapsed_sha256 and r.runs_sha256 for r in rows)
    assert [(r.n_runs, r.length, r.exponent_milli) for r in rows if r.doc_id is None] == [(1, 30, 30000)]
