"""SimHash, components, suffix-array dedup, top-k, and the native operators: brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textflow.llm import components, exact_topk, license_scan, quotes, registry, simhash, suffix_dedup, url_filter

SF001 = "/root/testdata/sf0.001"


def joined(edges, nodes):
    """Smallest node of each node's component."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ---


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    hub = [(5, i) for i in range(200, 240)]
    odd = [(7, 7), (300, 301), (301, 300), (300, 301)]
    back = [(900 - i, 901 - i) for i in range(20)]
    edges = chain + hub + odd + back
    got = components.components(spark.createDataFrame(edges + [(None, 1), (2, None)], "a bigint, b bigint")).collect()
    want = joined(edges, {n for e in edges for n in e})
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- SimHash ---


def brute_fingerprint(text, shingle=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_every_word_is_near_an_anchor():
    values = np.arange(1 << 16, dtype=np.uint32)
    home = simhash.homes(values)
    assert (np.bitwise_count(home ^ values) <= 1).all() and (simhash._syndrome(home) == 0).all()
    rows, anchors = simhash.visits(values, 1)
    assert (np.bitwise_count(values[rows] ^ anchors) <= 2).all()
    assert len(set(zip(rows.tolist(), anchors.tolist(), strict=True))) == len(rows)
    codes = np.unique(home)
    for v in random.Random(1).sample(range(1 << 16), 50):
        assert set(anchors[rows == v].tolist()) == set(codes[np.bitwise_count(codes ^ np.uint32(v)) <= 2].tolist())


@pytest.mark.parametrize("most", [4096, 3])
def test_links_equal_brute_force(spark, most):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)] + [0]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 4]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp bigint"), most=most).collect()
    got = joined([(r.a % (1 << 64), r.b % (1 << 64)) for r in edges], prints)
    assert got == joined(pairs, prints)


@pytest.mark.parametrize("most", [4096, 8])
def test_links_of_a_crowd_at_one_anchor(spark, most):
    """Many prints with one home, which all visit anchors that are nobody's home."""
    rng = random.Random(9)
    crowd = {rng.getrandbits(48) << 16 for _ in range(400)}
    crowd |= {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in rng.sample(sorted(crowd), 60)}
    prints = sorted(crowd)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 4]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp bigint"), most=most).collect()
    assert joined([(r.a % (1 << 64), r.b % (1 << 64)) for r in edges], prints) == joined(pairs, prints)


def test_op6_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    want = joined([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 4], ids)
    rows = registry.op6_simhash(spark, SF001).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_simhash_edges(spark):
    rows = [(3, None), (2, ""), (9, " \n\t"), (5, "one two"), (5, "one two"), (None, "ONE  two"), (6, "x " * 40000), (None, "nothing like it at all, no")]
    out = simhash.with_component(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in out)
    zero = "0" * 16
    assert got[(3, zero, 2)] == got[(2, zero, 2)] == got[(9, zero, 2)] == 1
    assert got[(5, f"{brute_fingerprint('one two'):016x}", 5)] == 2 and got[(None, f"{brute_fingerprint('one two'):016x}", 5)] == 1
    assert got[(6, f"{brute_fingerprint('x ' * 40000):016x}", 6)] == 1 and len(out) == len(rows)
    assert [r.component_id for r in out if r.doc_id is None and r.component_id is None] == [None]
    kept = simhash.first_of_each(spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, fp string")).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 2, 5, 6] and kept[0].fp == "s"
    assert simhash.with_component(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# --- suffix arrays ---


def brute_removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append((bytes(b for i, b in enumerate(t) if i not in gone), sum(i in gone and i - 1 not in gone for i in range(len(t)))))
    return out


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice([b"ab", b"abc", bytes(range(97, 123)), b"a", bytes(range(256))])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        assert suffix_dedup.suffix_order(text, 1000).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_windows_have_one_context_each():
    rng = random.Random(6)
    parts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 39, 40, 41, 300, 90)] + [b"a" * 100]
    covered = [[0] * max(0, len(p) - 39) for p in parts]
    for i, first, last, _ in suffix_dedup.contexts_of(parts, 40):
        for k in range(first, last + 1):
            covered[i][k] += 1
    assert all(n == 1 for c in covered for n in c)


@pytest.mark.parametrize("most", [256, 1])
def test_removed_bytes_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PLACE", 9)  # texts beyond 511 bytes are cut into parts
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [prose(60), prose(200), "z" * 50]
    texts = [None, "", "short", "y" * 3000, prose(1500)] + [prose(rng.randint(0, 90)) + rng.choice(shared)[rng.randint(0, 20):] + prose(rng.randint(0, 90)) for _ in range(40)]
    texts += [texts[7], texts[7], texts[8][:70] + prose(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=40, most=most).collect()}
    for i, (kept, spans) in enumerate(brute_removed([(t or "").encode() for t in texts], 40)):
        assert (bytes(got[i].kept), len(got[i].spans)) == (kept, spans), i
        assert sum(s.end - s.start for s in got[i].spans) == len((texts[i] or "").encode()) - len(kept)
    assert len(got) == len(texts)


def test_op3_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = brute_removed([r.text.encode() for r in rows], 400)
    got = {r.doc_id: r for r in registry.op3_suffix_dedup(spark, SF001).collect()}
    assert len(got) == len(rows)
    for r, (kept, spans) in zip(rows, want, strict=True):
        n = len(r.text.encode())
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(empty).collect() == []


# --- top-k ---


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "BLOCK", 7)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-2, 2)]) for _ in range(6)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (None, [0.0] * 6),
             (104, [1e30] * 6), (105, []), (110, []), (106, [1.0, 2.0]), (110, [3.0] * 4), (7, rows[8][1]), (60, rows[0][1]), (60, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = vectors.where("vec_id % 10 = 0")
    got = exact_topk.search(vectors, asked, 5).collect()
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {(q, tuple(v)) for q, v in usable if q % 10 == 0}:
        best = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v)]
        best = sorted(x for x in best if -2**63 < x[0] <= 2**63)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert exact_topk.search(vectors.limit(0), asked.limit(0), 5).collect() == []


def test_topk_keeps_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "BLOCK", 7)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(30)]
    rows += [(i, [rng.uniform(-5.8e6, 5.8e6) for _ in range(4)]) for i in range(30, 60)]
    rows += [(60, [5000.0, 0.1, 0.2, 0.3]), (61, [-1.1e7, 0.0, 0.0, 0.5]), (70, [1.1e7, 0.0, 0.0, 0.5]), (71, [1e9, 0.0, 0.0, 0.0]),
             (80, [1e9, 0.0, 0.0, 0.0]), (81, [1e300, 0.0, -3.0, 0.0]), (90, [0.0, 1e200, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = exact_topk.search(vectors, vectors.where("vec_id % 10 = 0"), 5).collect()
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in usable:
        if q % 10 == 0:
            best = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q]
            best = sorted(x for x in best if -2**63 < x[0] <= 2**63)[:5]  # a score beyond a long is none
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


# --- native operators against their SQL ---


@pytest.fixture
def database():
    con = duckdb.connect()
    yield con
    con.close()


def same(df, con, sql):
    rows = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    want = sorted(repr(tuple(dict(zip(rows.columns, r, strict=True))[c] for c in names)) for r in rows.fetchall())
    assert got == want


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan


LICENSED = ["Released under the MIT License.", "apache license, VERSION 2; under the mit license under the MIT license", "CC-BY-NC cc by nc", None, "", "two words",
            "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software", "this work is licensed under a creative commons attribution sharealike",
            "under the mit licenses", "Licensed under the Apache License, Version 2.0 (the License)", "under the mİt license", "cc by nc " * 3000,
            "permission is hereby granted free of charge but nothing else", "üunder the mit license", "x" * 50000,
            "creative commons attribution blah commons attribution noncommercial", "creative commons attribution commons attribution noncommercial",
            "obtaining a copy of this software any person obtaining permission is hereby granted free of charge to any person"]


def test_license_scan_equals_sql(spark, database, tmp_path):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0]), (0, LICENSED[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    database.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = registry.op8_license_scan(spark, str(tmp_path))
    no_python(found)
    same(found, database, license_scan.oracle_sql())
    by = {r.doc_id: r for r in found.collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (3, 0, 8, "apache-2,mit")
    assert by[6].labels == "mit" and by[6].base_labels == "" and 0.8 <= by[6].score <= 1 and by[7].labels == "cc-by-sa"
    # words of a notice in another order, or with others between them, are no notice
    assert (by[15].labels, by[15].score) == ("", 1.0) and by[17].labels == ""
    assert registry.license_scan.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert by[11].n_base == 3000 and by[10].n_base == 0 and by[13].n_base == 0 and by[3].n_words == 0


PAGES = [("http://A.example.net/en/1", ""), ("https://a.example.net/de/1#x", ""), ("http://example.com/de/", ""), ("http://example.com/de", ""),
         ("http://other.org/x", '<link rel="canonical" href="http://bad.net/y">'), ("http://third.org/z", "<META http-equiv=refresh content='0; url=http://other.org/x'>"),
         ("http://ok.org/fr/a", '<link href="http://bad.net/y" rel=canonical>'), (None, "x"), ("no url", None), ("http://", ""), ("http://notexample.com/de/", ""),
         ("http://x.com", '<link rel="canonical" href="/home">'), ("http://x.com/home/", ""), ("ftp://net/x?q#f", ""), ("http://net", ""), ("http://third.org/z", "")]


def test_url_filter_equals_sql(spark, database, tmp_path):
    rows = [(i, u, h) for i, (u, h) in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    database.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = registry.op4_url_filter(spark, str(tmp_path))
    no_python(found)
    same(found, database, url_filter.oracle_sql())
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert by[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[1][2:] == ("net/", "block")
    assert by[2][3] == "block" and by[3] == ("example.com", "/de", None, "block")  # its alias with a final / is blocked
    assert by[4][3] == by[5][3] == by[15][3] == "block" and by[6][2:] == ("org/fr/", "allow")
    assert by[7] == by[8] == ("", "", None, "allow") and by[10][3] == by[11][3] == "allow" and by[14] == ("net", "", None, "allow")


def test_edges_of_escaped_relative_and_further_targets(spark):
    link = lambda target: f'<link rel="canonical" href="{target}">'
    cases = [("http://h/p", link("http://h/q?page=2&amp;ref=x"), ["http://h/q?page=2&ref=x"]),
             ("http://h/p", link("http:&#47;&#x2F;h/q?a=1&#38;b=&#xe9;&amp;#38;&#38;amp;&#x110000;"), ["http://h/q?a=1&b=é&#38;&amp;&#x110000;"]),
             ("http://h/a/b?x#y", link("page2"), ["http://h/a/page2"]), ("http://h", link("page2?u=http://z/"), ["http://h/page2?u=http://z/"]),
             ("http://h/a/b?x", link("?id=5"), ["http://h/a/b?id=5"]), ("http://h/a/b/c", link("../x"), ["http://h/a/x"]),
             ("http://h/a/b", link("../../../x/./y/.."), ["http://h/x/"]), ("http://h/a", link("#top"), ["http://h/a"]),
             ("http://h/a", link("//other/x"), ["http://other/x"]), ("http://h/a", link("/b/../c"), ["http://h/c"]),
             ("http://h/a", '<base href="http://g/k/">' + link("x"), ["http://g/k/x"]),
             ("http://h/a", link("http://i/1") + link("http://i/2") + "<meta http-equiv=refresh content='0; url=http://i/3'>"
              "<meta http-equiv=refresh content='0; url=http://i/4'>", [f"http://i/{k}" for k in range(1, 5)]),
             ("http://h/a", None, []), ("http://h/a", "canonical", [])]
    pages = spark.createDataFrame([(u, h) for u, h, _ in cases], "url string, html string")
    got = sorted((r.source, r.target) for r in url_filter.page_edges(pages).collect())
    assert got == sorted((u, target) for u, _, targets in cases for target in targets)
    pages = spark.createDataFrame([("http://ok.org/a/1", link("../de/x?p=2&amp;r=1")), ("http://ok.org/de/x?p=2&r=1", link("http://ok.org/z") + link("//bad.net/"))],
                                  "url string, html string")
    found = url_filter.filter_urls(pages.select("url"), url_filter.page_edges(pages), url_filter.rule_table(spark, url_filter.RULES))
    no_python(found)
    assert {r.verdict for r in found.collect()} == {"block"}


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, rule string")
    edges = spark.createDataFrame([], "source string, target string")
    assert url_filter.filter_urls(pages, edges, url_filter.rule_table(spark, url_filter.RULES)).collect() == []


# --- quotation linking ---

TALK = [(1, 0, "Hello there\nmy old friend.\n\nHow are you?"), (1, 1, "Ann wrote:\n> Hello there\n> my old friend.\nFine thanks."), (1, 2, "Something else."),
        (1, 3, "Bob wrote:\n> Ann wrote:\n> > Hello there my old\n> > friend.\n> Fine thanks.\nGlad to hear."), (1, 4, "> How are you?\nGood."), (1, 5, "> unknown\nhm"),
        (1, 5000, ">  FINE   thanks.\nyes"), (2, 0, "> Hello there\nx"), (2, 1, "later\n\nwords"), (2, 2, "words"), (2, 3, "> words\nsame"), (None, 1, "> a"), (3, None, "> b"), (4, 1, None),
        (4, 2, ""), (4, 3, "a > b"), (4, 3, "a > b"), (5, 1, "> " * 500 + "deep\n" + "x\n" * 3000),
        (6, 0, "alpha beta\ngamma delta\nepsilon zeta\n\nsecond part"), (6, 1, "> alpha beta\n> Gamma  delta\nyes"), (6, 2, "> epsilon zeta\n> second part\nno"),
        (6, 3, "> alpha beta\n> of other words\nhm"), (6, 4, "Gamma delta\nmore"), (6, 5, "> beta\n> gamma delta\nok")]


def test_quotes_are_linked_and_removed(spark):
    talk = spark.createDataFrame([(*r, "old") for r in TALK], "conv_id bigint, turn bigint, text string, thread string")
    found = quotes.link(talk)
    no_python(found)
    rows = found.collect()
    assert len(rows) == len(TALK)
    by = {(r.conv_id, r.turn): (r.n_quoted, r.n_linked, r.reply_to, r.thread, r.clean_text) for r in rows}
    assert by[1, 1] == (1, 1, 0, 0, "Fine thanks.") and by[1, 3] == (2, 2, 1, 0, "Glad to hear.") and by[1, 4] == (1, 1, 0, 0, "Good.")
    assert by[1, 5000] == (1, 1, 1, 0, "yes") and by[1, 5] == (1, 0, None, 5, "hm") and by[1, 2] == (0, 0, None, 2, "Something else.")
    assert by[2, 0][2] is None and by[2, 3][2] == 2  # never from another conversation, the latest of equals
    assert by[None, 1][3] == 1 and by[3, None][3] is None and by[4, 1][4] is None and by[4, 3][4] == "a > b" and by[5, 1][0] == 1
    # a trimmed quote, two paragraphs in one, and quotes of which half of the words or less, and more than half, are found
    assert [by[6, t][:4] for t in (1, 2, 3, 5)] == [(1, 1, 0, 0), (1, 1, 0, 0), (1, 0, None, 3), (1, 1, 4, 4)]
    order = [(r.thread, r.position, r.turn) for r in rows if r.conv_id == 1]
    assert order == [(0, 0, 0), (0, 1, 1), (0, 2, 3), (0, 3, 5000), (0, 4, 4), (2, 0, 2), (5, 0, 5)]  # along the replies, not by turn
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, text string")
    assert quotes.link(empty).collect() == []


@pytest.mark.parametrize("block", [3, 1024])
def test_replies_are_walked_in_order(spark, block, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rng = random.Random(4)
    replies = {(1, t): rng.randrange(max(0, t - 6), t) for t in range(1, 60) if t % 9}
    replies |= {(2, t): t - 1 for t in range(1, 120)} | {(3, t): 0 for t in range(1, 60)} | {(2, 500): 400}

    def walk(conv, turn):
        return [turn] + [t for (c, kid), to in sorted(replies.items()) if (c, to) == (conv, turn) for t in walk(conv, kid)]

    starts = sorted({(c, to) for (c, _), to in replies.items()} - set(replies))
    expected = {(c, t): (start, i) for c, start in starts for i, t in enumerate(walk(c, start))}
    rows = quotes._walked(spark.createDataFrame([(*k, v) for k, v in replies.items()], "conv bigint, turn bigint, source bigint")).collect()
    assert len(rows) == len(expected) and {(r.conv, r.turn): (r.thread, r.position) for r in rows} == expected


def test_quotes_equal_sql(spark, database, tmp_path):
    rng = random.Random(12)
    lines = ["Hello there", "my old friend.", "", "> Hello there", "> my old friend.", ">> Hello there", "Ann wrote:", "Fine  THANKS.", "> fine thanks.", ">", "> > my old friend.", "a third line", "> a third line"]
    more = [(9, t, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for t in range(40)]
    talk = spark.createDataFrame([(c, t, "user", x) for c, t, x in TALK + more], "conv_id bigint, turn bigint, role string, text string")
    talk.write.parquet(f"{tmp_path}/conversations.parquet")
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = registry.op2_quotes(spark, str(tmp_path))
    assert sum(r.n_linked for r in found.collect()) > 20
    same(found, database, quotes.oracle_sql())


def test_op2_whole_table(spark):
    rows = registry.op2_quotes(spark, SF001).collect()
    source = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()}
    assert len(rows) == len(source) and all(r.clean_text == source[r.conv_id, r.turn] or ">" in source[r.conv_id, r.turn] for r in rows)
