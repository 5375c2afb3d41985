"""Word vectors by tables: nearest words, repeatability, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.operators.features import word_vectors
from textflow.operators.term_index import numbered
from textflow.operators.word_tables import fit_word_tables, mean_vectors, neighbour_pairs

GROUPS = [[f"{g}{i}" for i in range(6)] for g in "abc"]


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice(GROUPS[i % 3]) for _ in range(12)]) for i in range(300)] + [(900, []), (901, None), (902, ["once"])]
    return spark.createDataFrame(rows, "id bigint, filtered array<string>")


def nearest(vectors):
    terms = sorted(vectors)
    m = np.array([vectors[t] for t in terms], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T
    np.fill_diagonal(close, -2)
    return {t: {terms[j] for j in np.argsort(-close[i])[:5]} for i, t in enumerate(terms)}


def test_pairs_equal_brute_force(spark):
    docs = [["x", "y", "rare", "x"], ["y", "y", "x"], [], None]
    rows = numbered(spark.createDataFrame([(d,) for d in docs], "filtered array<string>"))
    words = spark.createDataFrame([("x", 0, 3), ("y", 1, 3)], "term string, index bigint, n bigint")
    want = {}
    for d in docs:
        kept = [{"x": 0, "y": 1}[t] for t in d or [] if t != "rare"]
        for i, a in enumerate(kept):
            for j, b in enumerate(kept):
                if i != j and abs(i - j) <= 2:
                    want[a, b] = want.get((a, b), 0) + (3 - abs(i - j)) / 2
    got = {(r.a, r.b): r.weight for r in neighbour_pairs(rows, words, "filtered", 2).collect()}
    assert got == pytest.approx(want)


def test_nearest_words_agree_with_spark(toy):
    table = fit_word_tables(toy, size=12, blocks=3, epochs=8)
    ours = {r.term: r.vector for r in table.collect()}
    assert sorted(ours) == sorted(w for g in GROUPS for w in g)  # "once" is too rare
    model, _ = word_vectors(toy.where(F.size("filtered") > 0), "id", size=12, partitions=1, max_iter=30)
    theirs = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert nearest(ours) == nearest(theirs) == {w: set(g) - {w} for g in GROUPS for w in g}
    again = fit_word_tables(toy.repartition(5), size=12, blocks=3, epochs=8)
    assert {r.term: r.vector for r in again.collect()} == ours
    means = {r.id: r.vector.toArray() for r in mean_vectors(toy, "id", table).collect()}
    rows = {r.id: r.filtered for r in toy.collect()}
    assert set(means) == set(range(300))
    assert np.allclose(means[7], np.mean([ours[w] for w in rows[7]], axis=0), atol=1e-6)


def test_no_words(spark):
    none = spark.createDataFrame([], "filtered array<string>")
    assert fit_word_tables(none, size=4, blocks=2).collect() == []


def test_document_means_come_from_a_table_by_blocks(spark, toy, monkeypatch):
    """Vectors are a table, more blocks are taken for more tokens, and every row stays, also those without words."""
    from textflow.operators import word_tables as WT

    monkeypatch.setattr(WT, "BLOCK_TOKENS", 500)
    assert WT.block_count(toy, "filtered", 2) == 8  # 3,601 tokens
    model, out = word_vectors(toy, "id", size=6, partitions=2)
    assert sorted(model.table.columns) == ["n", "term", "vector"]
    words = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    rows = out.collect()
    assert sorted(r.id for r in rows) == [*range(300), 900, 901, 902]
    for r in rows:
        want = sum((words[w] for w in r.filtered or [] if w in words), np.zeros(6)) / max(len(r.filtered or []), 1)
        assert np.allclose(r.wordvectors.toArray(), want, atol=1e-6)


def test_pairs_are_added_up_in_blocks(spark, monkeypatch):
    """Blocks add up their own pairs, some tokens at a time, before anything is shuffled by pair; no row for each token and distance."""
    from textflow.operators import word_tables as WT

    monkeypatch.setattr(WT, "PAIR_TOKENS", 7)
    rng = random.Random(8)
    docs = [[rng.choice("abcdefz") for _ in range(rng.randrange(30))] for _ in range(25)]
    rows = numbered(spark.createDataFrame([(d,) for d in docs], "filtered array<string>"))
    words = spark.createDataFrame([(t, 90 - i) for i, t in enumerate("abcdef")], "term string, index bigint")
    want = {}
    for d in docs:
        kept = [90 - "abcdef".index(t) for t in d if t != "z"]
        for i, a in enumerate(kept):
            for j, b in enumerate(kept):
                if 0 < abs(i - j) <= 3:
                    want[a, b] = want.get((a, b), 0) + (4 - abs(i - j)) / 3
    pairs = neighbour_pairs(rows, words, "filtered", 3, blocks=3)
    assert {(r.a, r.b): r.weight for r in pairs.collect()} == pytest.approx(want)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_blocks_pass_in_rounds(spark, toy, monkeypatch):
    """Some blocks at a time give the same words, means and neighbours, and nothing but the result is left on disk."""
    from textflow.operators import word_tables as WT

    whole = {r.term: r.vector for r in fit_word_tables(toy, size=12, blocks=5, epochs=8).collect()}
    monkeypatch.setattr(WT, "ROUND", 2)
    held = []
    monkeypatch.setattr(WT, "in_blocks", lambda rows, col, block, blocks, *a, f=WT.in_blocks: held.append(blocks) or f(rows, col, block, blocks, *a))
    some = {r.term: r.vector for r in fit_word_tables(toy, size=12, blocks=5, epochs=8).collect()}
    assert held == [2, 2, 1] * 8 and set(some) == set(whole)
    assert nearest(some) == nearest(whole)
    assert all(np.allclose(some[w], whole[w], rtol=0.05, atol=0.05) for w in whole)
    written = []
    monkeypatch.setattr(WT, "lineage_cut", lambda df, f=WT.lineage_cut: written.append(f(df)) or written[-1])
    model, out = word_vectors(toy, "id", size=6, partitions=5)
    rows = out.collect()
    words = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert sorted(r.id for r in rows) == [*range(300), 900, 901, 902]
    for r in rows:
        want = sum((words[w] for w in r.filtered or [] if w in words), np.zeros(6)) / max(len(r.filtered or []), 1)
        assert np.allclose(r.wordvectors.toArray(), want, atol=1e-6)
    import os
    left = [f for df in written for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    assert len({os.path.dirname(f) for f in left}) == 2  # the words with their counts and their vectors
