import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

import pyrules as R
from textflow.operators import features as FE
from textflow.operators import term_index as TI
from textflow.operators.stopwords import ENGLISH_STOP_WORDS


def test_stop_word_list_is_sparks(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenizer_quirks(spark):
    df = spark.createDataFrame([(0, "Is it  true"), (1, " "), (2, ""), (3, " a\tB ")], "id int, t string")
    got = {r.id: r.w for r in FE.tokenize(df, "t", "w").collect()}
    assert got == {0: ["is", "it", "", "true"], 1: [], 2: [""], 3: ["", "a", "b"]}
    assert all(got[i] == R.tokens(t) for i, t in enumerate(["Is it  true", " ", "", " a\tB "]))


def test_contractions_survive_stop_words(spark):
    # "'" became a space during cleaning, so "i'll" cannot match any more
    df = spark.createDataFrame([(0, ["i", "ll", "the", "cat", ""])], "id int, w array<string>")
    assert FE.remove_stop_words(df, "w", "f").first().f == ["ll", "cat", ""]


DOCS = [["a", "b", "a"], ["b", "c"], ["a"], []]


def numbered(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "id int, f array<string>")


def test_term_counts_and_tfidf_rows(spark):
    df = numbered(spark, DOCS)
    got = {(r.id, r.term): r.tf for r in FE.term_count_rows(df, "id", "f").collect()}
    want = {(i, t): n for i, d in enumerate(DOCS) for t, n in Counter(d).items()}
    assert got == want
    idf = {t: math.log((len(DOCS) + 1) / (sum(t in d for d in DOCS) + 1)) for t in "abc"}
    assert {r.term: round(r.idf, 9) for r in FE.idf_rows(df, "f").collect()} == {t: round(x, 9) for t, x in idf.items()}
    rows = {(r.id, r.term): round(r.tfidf, 9) for r in FE.tf_idf_rows(df, "id", "f").collect()}
    assert rows == {(i, t): round(n * idf[t], 9) for (i, t), n in want.items()}
    # the vectors that models read hold the same numbers
    numbered_rows = TI.numbered(df)
    index = TI.fit_term_index(numbered_rows, "f")
    vectors = TI.term_vectors(numbered_rows, index, "f", "tf", "w")
    assert {(r.id, r.term): round(r.value, 9) for r in TI.vector_rows(vectors, index, "id", "w").collect()} == rows
    assert {(r.id, r.term): r.value for r in TI.vector_rows(vectors, index, "id", "tf").collect()} == want
    assert {r.id: r.tf.size for r in vectors.collect()} == dict.fromkeys(range(len(DOCS)), 3)
    # Spark's own IDF gives the same weights on these vectors
    _, again = FE.tf_idf(vectors.drop("w"), "tf", "w")
    assert {r.id: r.w.toArray().round(9).tolist() for r in again.collect()} == {r.id: r.w.toArray().round(9).tolist() for r in vectors.collect()}
    assert {r.word: r.n for r in FE.counted_words(df, "f", 2).collect()} == {"a": 3, "b": 2}


def terms(index):
    return [r.term for r in index.table.orderBy("index").collect()]


def test_term_index_order_and_bound(spark):
    df = numbered(spark, [["b", "a", "c", "c"], ["é", "B", "a"], ["a", "b"]])
    index = TI.fit_term_index(df, "f")
    assert terms(index) == ["a", "b", "c", "B", "é"] and (index.size, index.documents) == (5, 3)
    assert [(r["index"], r.n, r.doc_freq) for r in index.table.orderBy("index").collect()] == [(0, 3, 3), (1, 2, 2), (2, 2, 1), (3, 1, 1), (4, 1, 1)]
    assert terms(TI.fit_term_index(df, "f", min_df=2)) == ["a", "b"]
    assert terms(TI.fit_term_index(df, "f", min_df=0.9)) == ["a"]


def test_term_index_over_many_partitions(spark):
    words = [[f"w{i}"] * (i % 7 + 1) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = TI.fit_term_index(numbered(spark, words).repartition(5), "f")
        assert index.table.select("index").distinct().count() == index.size == 3000
        want = sorted((f"w{i}" for i in range(3000)), key=lambda w: (-(int(w[1:]) % 7 + 1), w))
        assert terms(index) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_term_vectors_of_rows_with_unknown_terms_and_repeated_ids(spark):
    index = TI.fit_term_index(numbered(spark, [["a", "b", "a"], ["b"]]), "f")
    rows = TI.numbered(spark.createDataFrame([(1, ["a", "z", "a"], 5), (1, ["b"], 6), (2, [], 7), (3, None, 8)], "id int, f array<string>, e int"))
    got = {r.e: r.rawFeatures.toArray().tolist() for r in TI.term_vectors(rows, index, "f").collect()}
    # a and b both occur twice, so they are numbered by code point
    assert got == {5: [2.0, 0.0], 6: [0.0, 1.0], 7: [0.0, 0.0], 8: [0.0, 0.0]}
    assert TI.term_vectors(rows, index, "f", weights=None, min_tf=2).where("e = 6").first().rawFeatures.numNonzeros() == 0
    none = TI.fit_term_index(numbered(spark, [[]]).limit(0), "f")
    assert none.size == 0 and TI.term_vectors(rows, none, "f").first().rawFeatures.size == 0


def test_word_vectors_are_means(spark):
    df = numbered(spark, [["x", "y", "z"], ["x", "y"], ["y", "q"]])
    model, out = FE.word_vectors(df, "id", "f", "v", size=8, min_count=2)
    words = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert sorted(words) == ["x", "y"]
    for r in out.collect():
        want = sum(words[w] for w in r.f if w in words) / len(r.f)
        assert np.allclose(r.v.toArray(), want, atol=1e-6)
    a = FE.assemble(out.withColumn("n", F.lit(1.0)), ["v", "n"], "features")
    assert a.first().features.size == 9


# What a fit gives, run in a session with another number of cores.
FIT = """
import sys
from textflow.session import local_session
from textflow.operators import features as FE, term_index as TI, topics as TO
spark = local_session(sys.argv[1])
docs = [[f"w{(i * 7 + j * j) % 11}" for j in range(i % 5 + 3)] for i in range(60)]
df = spark.createDataFrame(list(enumerate(docs)), "id int, f array<string>").repartition(int(sys.argv[1]) + 1)
model, _ = FE.word_vectors(df, "id", "f", "v", size=4, partitions=1)
rows = TI.numbered(df)
feats = TI.term_vectors(rows, TI.fit_term_index(rows, "f"), "f")
lda = TO.fit_topics(feats, "id", k=3, max_iter=5)
print("FIT", [(r.word, [round(float(x), 4) for x in r.vector]) for r in model.getVectors().orderBy("word").collect()],
      [round(float(x), 4) for x in lda.topicsMatrix().toArray().ravel()])
"""


def test_fits_do_not_follow_the_number_of_cores():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = [subprocess.run([sys.executable, "-c", FIT, cores], cwd=root, env={**os.environ, "PYTHONPATH": root}, check=True,
                          capture_output=True, text=True).stdout.partition("FIT")[2] for cores in ("2", "8")]
    assert out[0] and out[0] == out[1]


def test_tokenizer_and_words_match_python_rules(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from textflow.functions.text import words_of
    alphabet = "abcXYZéÉ01 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　,.'"

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet, max_size=20), min_size=10, max_size=30))
    def check(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
        toks = FE.tokenize(df, "t", "w").select("i", "w", words_of(F.col("t")).alias("s")).collect()
        for r in toks:
            assert r.w == R.tokens(values[r.i])
            assert r.s == values[r.i].split()

    check()


def test_term_counts_read_written_tokens(spark):
    """The tokens are made once, not again in the filter that Spark adds for empty lists."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, ""), (3, None), (None, "b b")], "id int, t string").where(F.col("t").isNotNull())
    counts = FE.term_count_rows(FE.remove_stop_words(FE.tokenize(docs, "t", "w"), "w", "filtered", ["zz"]), "id")
    assert "UDF" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r.id or 0, r.term), r.tf) for r in counts.collect()) == [((0, "b"), 2), ((1, "a"), 3), ((1, "b"), 1), ((2, ""), 1)]
