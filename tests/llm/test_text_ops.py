"""Line dedup, language ID, byte-level BPE, decontamination: brute force, exact round trips, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.llm import byte_bpe, decontaminate, language_id, line_dedup, registry

SF001 = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def bpe(spark):
    import public_tokenizers
    import tiktoken

    tokens, pattern = registry.vocabulary(spark)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(tokens)})
    return tokens, pattern, reference


def test_bpe_equals_tiktoken_on_random_text(bpe):
    tokens, pattern, reference = bpe
    encoder = byte_bpe._Encoder(byte_bpe.model_bytes(tokens), tokens, pattern)
    letters = [chr(c) for c in [*range(300), 0x85, 0xA0, 0x1680, 0x2028, 0x2581, 0x3000, 0x4E2D, 0x1F600, 0x301]] + list("aeio tsn'  \n") * 20
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert encoder(text).tolist() == reference.encode_ordinary(text), text


def test_bpe_round_trip_and_edges(spark, bpe):
    tokens, pattern, reference = bpe
    texts = [None, "", " ", "a" * 5000, "<|endoftext|>", "<unk>", "é\u0000\n\n x", "word " * 3000]
    docs = frame(spark, [(t,) for t in texts], "text string")
    rows = docs.withColumn("ids", byte_bpe.encode(F.col("text"), tokens, pattern)).withColumn("b", byte_bpe.decode(F.col("ids"), tokens)).collect()
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.b) == (r.text or "").encode()


def test_bpe_empty_tables_and_negative_ids(spark, bpe):
    tokens, pattern, _ = bpe
    none = frame(spark, [], "text string")
    assert none.select(byte_bpe.encode(F.col("text"), tokens, pattern).alias("i")).collect() == []
    assert registry.token_digests(frame(spark, [], "doc_id bigint, text string"), tokens, pattern).collect() == []
    for bad in ([0, -1], [len(tokens)], [1, None]):
        with pytest.raises(Exception, match="negative"):
            frame(spark, [(bad,)], "ids array<int>").select(byte_bpe.decode(F.col("ids"), tokens)).collect()
    rows = frame(spark, [(None,), ([],), ([300, 5],), (None,), ([7],)], "ids array<int>").coalesce(1).select(byte_bpe.decode(F.col("ids"), tokens).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in rows] == [None, b"", tokens[300] + tokens[5], None, tokens[7]]


def test_bpe_long_texts_are_read_in_pieces(bpe, monkeypatch):
    tokens, pattern, reference = bpe
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(byte_bpe, "MEMORY_ENTRIES", 3)
    encoder = byte_bpe._Encoder(byte_bpe.model_bytes(tokens), tokens, pattern)
    text = "some longer text, with " * 40
    assert encoder(text).tolist() == reference.encode_ordinary(text)
    texts = ["some", None, text, "", "with more words in it", text, "x" * 70, "end"]
    found = [np.frombuffer(ids, np.int32).tolist() for ids in encoder.each(texts)]
    assert found == [reference.encode_ordinary(t or "") for t in texts]


def test_op7_whole_table(spark, bpe):
    _, _, reference = bpe
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = registry.op7_byte_bpe(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_vocabulary_must_be_complete(spark, tmp_path):
    (tmp_path / "v").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_vocabulary(spark, str(tmp_path / "v"))


# --- decontamination ---


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in body or ""))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i:i + window]
            for k in range(len(words) - len(part) + 1):
                if words[k:k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(item)
    return len(words), sorted(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_hits_equal_brute_force(spark, most):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "Ä", "d1"])
    items = [(1, "a b c"), (2, "b"), (3, None), (4, "?!"), (None, "c c"), (6, "A B, c; a b Ä a"), (6, "d1 d1 a b"), (1, "a b c")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "A-b c"), (1, "b")]
    got = decontaminate.with_hits(frame(spark, docs, "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string"),
                                  window=3, most=most).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute_hits(r.text, items, 3)
        assert (r.hits.n_words, r.hits.words, r.hits["items"]) == (n, hit, found), r.text
    for r in got:
        assert [k for s in r.hits.spans for k in range(s["first"], s["last"] + 1)] == r.hits.words
        assert all(b["first"] > a["last"] + 1 for a, b in zip(r.hits.spans, r.hits.spans[1:], strict=False))
        for s in r.hits.spans:
            words = brute_hits(r.text.encode()[s.start:s.end].decode(), items, 3)[0]
            assert words == s["last"] - s["first"] + 1


def test_no_items_no_docs_and_clashing_names(spark):
    none = frame(spark, [], "item_id bigint, text string")
    docs = frame(spark, [(1, "a b", "x")], "doc_id bigint, text string, hits string")
    assert decontaminate.with_hits(docs, none).select("hits.n_words").collect() == [(2,)]
    assert decontaminate.with_hits(docs.limit(0), none).collect() == []


def test_op9_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in registry.op9_decontaminate(spark, SF001).collect()}
    assert len(got) == len(docs) and any(r.contaminated for r in got.values())
    for d in docs[::7] + [d for d in docs if got[d.doc_id].contaminated][:5]:
        n, hit, found = brute_hits(d.text, items, 10)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


# --- line dedup ---

LONG = [f"line number {i} has quite enough words" for i in range(12)]


def dedup(spark, rows):
    out = line_dedup.dedup_lines(frame(spark, rows, "doc_id bigint, text string")).collect()
    return {(r.doc_id, k): r for k, r in enumerate(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_removed)))}, out


def test_later_copies_lose_their_lines(spark):
    whole = "\n".join(LONG)
    _, out = dedup(spark, [(5, whole), (2, whole), (9, "own first line with some words\n" + whole + "\nand a last line of its own")])
    by = {r.doc_id: r for r in out}
    assert by[2].text == whole and by[2].n_removed == 0
    assert by[5].text == "" and by[5].n_removed == 12 and by[5].n_partners == 1
    assert by[9].text == "own first line with some words\nand a last line of its own" and by[9].n_blocks == 1


def test_short_lines_inside_a_block_go_with_it(spark):
    a = "As.\n" + LONG[0] + "\nLe.\n\n" + LONG[1] + "\nEnd."
    _, out = dedup(spark, [(1, "As.\nLe.\nEnd."), (2, a), (3, "x\n" + a)])
    by = {r.doc_id: r.text for r in out}
    assert by[1] == "As.\nLe.\nEnd." and by[2] == a and by[3] == "x"


def test_copies_in_large_groups_and_common_lines(spark):
    common = "this very line stands in every document here"
    docs = [(i, f"{common}\nbut document {i} is otherwise its own text") for i in range(40)]
    copies = [(100 + i, "one line that forty documents consist of\nok") for i in range(40)]
    _, out = dedup(spark, docs + copies)
    by = {r.doc_id: r for r in out}
    assert all(by[i].n_removed == int(i > 0) for i in range(40))  # a common line goes like a rare one
    assert by[100].n_removed == 0 and all(by[100 + i].text == "" for i in range(1, 40))


@pytest.mark.parametrize("holders", [2, 10, 11, 60])
def test_a_short_line_goes_however_many_hold_it(spark, holders):
    _, out = dedup(spark, [(i, f"own {i}\nseven words are in this line here\nend {i}") for i in range(holders)])
    assert {r.doc_id: r.n_removed for r in out} == {i: int(i > 0) for i in range(holders)}


def test_long_line_goes_from_every_later_holder(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    _, out = dedup(spark, [(i, f"document {i} opens with this text\n{passage}\nand document {i} closes with that") for i in range(40)])
    assert {r.doc_id: r.n_removed for r in out} == {i: int(i > 0) for i in range(40)}


def test_text_of_one_line_still_pairs_by_that_line(spark):
    _, out = dedup(spark, [(1, LONG[0]), (2, "own first line\n" + LONG[0])])
    assert {r.doc_id: r.text for r in out} == {1: LONG[0], 2: "own first line"}


def test_blocks_in_another_order_or_repeated(spark):
    p, q, x, y = ("\n".join(LONG[i:i + 3]) for i in (0, 3, 6, 9))
    _, out = dedup(spark, [(1, p + "\n" + q), (2, q + "\n" + p), (3, "own text\n" + q + "\n" + p),
                           (4, f"a start\n{x}\n{y}\n{x}\n{y}\nan end"), (5, f"other start\n{x}\n{y}\n{x}\n{y}\nother end")])
    assert {r.doc_id: r.text for r in out if r.doc_id in (2, 3, 5)} == {2: "", 3: "own text", 5: "other start\nother end"}


def test_neighbouring_common_lines_with_two_owners(spark):
    x, y = "six words are in this line", "and six words are in that"
    docs = [(i, f"own text {i}\n{x if i < 12 else y}\nown end {i}") for i in range(24)]
    _, out = dedup(spark, [*docs, (30, f"B\n{x}\n{y}\nB."), (31, f"C\n{x}\n{y}\nC.")])
    assert {r.doc_id: r.n_removed for r in out if r.n_removed} == {i: 1 for i in range(1, 24) if i != 12} | {30: 2, 31: 2}


def test_short_lines_and_scripts_without_spaces(spark):
    menu = "\n".join(f"item {k}" for k in range(8))
    chinese, thai = "每个文档都有同样的一段文字" * 4, "ข้อความเดียวกันในทุกเอกสาร" * 3
    docs = [(1, "ok"), (2, "ok"), (3, menu), (4, menu), (5, "own\n" + menu + "\nown end"), (6, chinese + "\n甲"), (7, chinese + "\n乙"),
            (8, "a\n" + thai), (9, "b\n" + thai), (10, "x" * 200 + "\na"), (11, "x" * 200 + "\nb"), (12, "item 1\nitem 2"), (13, " \n"), (14, " \n")]
    _, out = dedup(spark, docs)
    gone = {r.doc_id: r.text for r in out if r.n_removed}
    assert gone == {2: "", 4: "", 5: "own\nown end", 7: "乙", 9: "b", 11: "b"}


def test_what_goes_lies_between_two_brute_forces(spark):
    """At least every run that an earlier document holds and that is an overlap, and
    nothing but runs of an earlier document with an overlap's words in them."""
    rng = random.Random(4)
    pool = [" ".join(f"w{k}" for _ in range(k % 7)) for k in range(12)]
    docs = [[rng.choice(pool) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    passages = [[rng.choice(pool) for _ in range(6)] for _ in range(4)]
    docs = [d + rng.choice(passages) + [f"end of {i}"] for i, d in enumerate(docs)]
    marked = [(i, "\n".join(d)) for i, d in enumerate(docs)]
    _, out = dedup(spark, marked)
    kept = {r.doc_id: r.text.split("\n") for r in out}
    for i, d in enumerate(docs):
        must, may, earlier = set(), set(), docs[:i]
        for a in range(len(d)):
            for b in range(a + 1, len(d) + 1):
                size = [len(x.split()) for x in d[a:b]]
                if any(d[a:b] == e[k:k + b - a] for e in earlier for k in range(len(e))):
                    if sum(size) >= line_dedup.ENOUGH or len(size) == 1 and size[0] >= line_dedup.MIN_WORDS:
                        must.update(range(a, b))
                    if sum(size) >= line_dedup.ENOUGH or max(size) >= line_dedup.MIN_WORDS:
                        may.update(range(a, b))
        rest = iter([x for k, x in enumerate(d) if k not in must])
        assert all(line in rest for line in kept[i] if line)
        rest = iter(kept[i])
        assert all(x in rest for k, x in enumerate(d) if k not in may)


def test_a_very_long_text_and_its_copy(spark):
    text = "\n".join(f"line {k} of a long text, in words" for k in range(30_000))
    _, out = dedup(spark, [(1, text), (2, "own\n" + text), (3, None)])
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in out} == {1: (30_000, 0), 2: (30_001, 30_000), 3: (0, 0)}


def test_line_dedup_edges(spark):
    _, out = dedup(spark, [(1, None), (2, ""), (None, LONG[0]), (7, LONG[0]), (7, LONG[0]), (8, "\n\n"), (8, "\n\n")])
    texts = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in out)
    assert texts == [(0, "", 1), (1, "", 0), (2, "", 0), (7, "", 1), (7, LONG[0], 0), (8, "\n\n", 0), (8, "\n\n", 0)]
    empty = frame(spark, [], "doc_id bigint, text string, runs string, n_lines string")
    assert line_dedup.dedup_lines(empty).collect() == []


def test_patience_aligns_in_order():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 15))]
        b = [rng.randint(0, 8) for _ in range(rng.randint(0, 15))]
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 9, 4], [1, 3, 2, 4]) in ([(0, 0), (1, 2), (4, 3)], [(0, 0), (2, 1), (4, 3)])


def test_op1_keeps_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = registry.op1_line_dedup(spark, SF001).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.n_lines == len(docs[r.doc_id].split("\n")) for r in rows)
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    gone = hashlib.sha256(b"").hexdigest()
    for r in rows:  # an exact copy with a long line loses everything, a first holder never does
        text = docs[r.doc_id]
        if first[text] != r.doc_id and any(len(x.split()) >= 5 for x in text.split("\n")):
            assert r.kept_sha256 == gone
        if r.n_removed == 0:
            assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- language ID ---


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = registry.op5_language_id(spark, SF001).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_language_id_edges(spark):
    rows = [(1, "the cat and the dog are in the house", "en"), (2, "der hund und die katze sind im haus", "de"),
            (2, "der hund und die katze sind im haus", "de"), (3, None, "en"), (4, "", "de"), (5, "the", None), (None, "12 34 !!", "fr"),
            (6, "und die katze " * 2000, "de")]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    got = docs.select("doc_id", "text", language_id.predict(F.col("text"), model).alias("p")).collect()
    by = {r.text: r.p for r in got}
    assert by[None].lang == by[""].lang == by["12 34 !!"].lang == "und" and by[None].score == 0 and by[""].rejected
    assert by["the"].lang == "en" and by["und die katze " * 2000].lang == "de"
    untrained = language_id.fit(docs.limit(0))
    assert {r.p.lang for r in docs.select(language_id.predict(F.col("text"), untrained).alias("p")).collect()} == {"und"}


def test_language_of_copies_is_learned(spark):
    german = F.concat(F.lit("der hund und die katze sind im haus nummer "), (F.col("id") % 5).cast("string"), F.lit(" geblieben"))
    english = F.concat(F.lit("the cat and the dog are in house number "), F.col("id").cast("string"))
    docs = spark.range(60000).select(german.alias("text"), F.lit("de").alias("lang")).unionByName(
        spark.range(500).select(english.alias("text"), F.lit("en").alias("lang")))
    drawn = language_id._sampled(docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang")), 400)
    n = {r["_lang"]: r["count"] for r in drawn.groupBy("_lang").count().collect()}
    assert n["de"] == 5 and 300 < n["en"] < 500
    few = language_id._sampled(docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang")), 0)
    assert {r["_lang"] for r in few.collect()} == {"de", "en"}
    assert set(language_id.fit(docs).languages) == {"de", "en"}


def test_rejects_what_is_far_from_every_language(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language_id.fit(docs)
    odd = frame(spark, [("中文文本 " * 40,), ("zqxj wvkq xzjq qqxz jkvw " * 20,)], "text string")
    assert all(r.p.rejected for r in odd.select(language_id.predict(F.col("text"), model).alias("p")).collect())
