"""

Queries bind the ``textflow`` operators to the shared test tables
(``textflow.sources.tables``): the labelled corpus is ``documents`` joined
with ``labels``, the lexicon is the word set of ``benchmark``, feature text
is derived from ``embeddings``. Every query reads whole tables.

Oracles are DuckDB SQL written from the rules (not from our code). Keys
whose result is a fitted model (word vectors, topics, classifiers) return
what can be computed without the model -- ids, labels, token counts, weights --
and flags that a wrong model fails: whether a document's vector is the mean
of its words', whether a classifier's scores agree and beat or equal the larger class
on its training rows, whether a topic model's scores imply the corpus's weight.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textflow.functions import arrays as A
from textflow.functions import text as T
from textflow.operators import features as FE
from textflow.operators import filters as FI
from textflow.operators import metrics as ME
from textflow.operators import models as MO
from textflow.operators import sampling as SA
from textflow.operators import term_index as TI
from textflow.operators import topic_tables as TT
from textflow.operators import word_tables as WT
from textflow.operators import topics as TO
from textflow.operators import vocab as VO
from textflow.plans import classifier as PC
from textflow.plans import cleaning as PL
from textflow.sources import corpus as SC
from textflow.session import lineage_cut, scratch_dir
from textflow.sources import tables as TB
from textflow.sources import word2vec as W2

FLAGSHIP_SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------------------
# Shared pieces
# ---------------------------------------------------------------------------


def _docs(spark, d):
    return TB.table(spark, d, "documents", ["doc_id", "text"])


def _corpus(spark, d):
    return TB.corpus(spark, d)


def _tuning_vocab(spark, d):
    return VO.build_vocab(PL.clean_corpus(_corpus(spark, d), "tuning"))


def _labels_pred(spark, d):
    lab = TB.table(spark, d, "labels")
    return lab.select("doc_id", (1 - F.col("quality")).cast("double").alias("prediction"),
                      F.col("toxic").alias("label"))


def _long(df, id_cols, arr):
    """Array column -> ``(ids..., pos bigint, value)`` rows (NULL items kept)."""
    return df.select(*id_cols, F.posexplode_outer(arr).alias("pos", "value")).select(
        *id_cols, F.col("pos").cast("long").alias("pos"), "value")


# Words appended to each text for the misspelling query, spaced apart, since
# the invented prose holds none of them (overlapping cases included).
MISSPELLING_PROBE = " colours wwiisnt didnt isnt whatsapp Colour centre theatres labourer snapchat"


def _tokens(spark, d):
    return FE.tokenize(_docs(spark, d), "text", "words")


def _main_tokens(spark, d):
    return PC.question_features(_corpus(spark, d), "main")


# Topics of the main pipeline and of the per-class and exploration models.
K_MAIN, K_CLASS = 8, 20
# The topic sweep: numbers of topics, and iterations.
SWEEP_KS, SWEEP_ITER = range(7, 20), 50


def _lda_input(spark, d):
    return PC.tfidf_features(_main_tokens(spark, d))


def _feature_vectors(spark, d, drop_value=9):
    return PC.load_feature_arrays(TB.feature_text(spark, d), "topics", "target",
                                  drop_value=drop_value, keep=("vec_id",))


def _model_check(pred, key):
    return pred.select(F.col(key), F.col("label").cast("int").alias("label"), F.col("prediction").isin(0.0, 1.0).alias("valid"))


# What a fitted classifier may fall short by on its own rows (see ``models.learned``).
GAP = 0.02


def _score(model, data):
    """One row for a fitted model on ``data`` (``part`` 0 for training, 1 held
    out): the held-out rows, positives and share of the larger class, whether
    the three scores agree on them (accuracy by hand, the evaluator's, and
    one less the squared RMSE), and whether the model has learned its own training
    rows: no step lowers a linear model's objective by more than ``GAP``, and
    others are as accurate as a threshold on one feature."""
    held = MO.predict(model, data.where(F.col("part") == 1))
    gap = MO.learned(model, data.where(F.col("part") == 0)).first().gap
    row = ME.report(held)
    rmse = ME.rmse(held).first()[0]
    return row.select("rows", "positives", "majority_share",
                      ((F.abs(F.col("accuracy") - ME.evaluate(held, "accuracy")) < 1e-5)
                       & (F.abs(F.col("accuracy") - (1 - rmse ** 2)) < 1e-5)).alias("scores_agree"),
                      F.lit(gap <= GAP).alias("learns"))


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------


def q_scan_corpus(spark, d):
    return _corpus(spark, d)


def q_rename_positional(spark, d):
    return SC.rename_positional(TB.table(spark, d, "labels"), "qid", "quality", "target")


def q_as_labelled(spark, d):
    return SC.as_labelled(TB.feature_text(spark, d), "target", "topics")


def q_non_empty(spark, d):
    conv = TB.table(spark, d, "conversations", ["conv_id", "turn", "text"])
    return FI.non_empty(conv.select("conv_id", "turn", T.ascii_only("text").alias("text")), "text") \
        .select("conv_id", "turn")


def q_of_class(spark, d):
    return FI.of_class(_corpus(spark, d), 1).select("qid", "target")


def q_has_length(spark, d):
    ft = TB.feature_text(spark, d).select("vec_id", A.parse_vector("topics").alias("a"))
    return FI.has_length(ft, "a", 64).select("vec_id")


def q_without_value(spark, d):
    ft = TB.feature_text(spark, d).select(
        "vec_id", "target", A.take_items(A.parse_vector("topics"), 1, 19).alias("a"))
    return FI.without_value(ft, "a", 9).select("vec_id", "target")


def q_build_vocab(spark, d):
    return VO.build_vocab(_docs(spark, d), "text")


def q_lexicon_words(spark, d):
    return TB.lexicon(spark, d)


def q_known_words(spark, d):
    return VO.known_words(_tuning_vocab(spark, d), TB.lexicon(spark, d))


def q_unknown_words(spark, d):
    return VO.unknown_words(_tuning_vocab(spark, d), TB.lexicon(spark, d))


def q_coverage(spark, d):
    return VO.coverage(_tuning_vocab(spark, d), TB.lexicon(spark, d))


def q_coverage_by_step(spark, d):
    return PL.coverage_by_step(_docs(spark, d), TB.lexicon(spark, d), "text")


def q_oov_by_count(spark, d):
    return VO.oov_by_count(_tuning_vocab(spark, d), TB.lexicon(spark, d))


def q_top_words(spark, d):
    return VO.top_words(VO.build_vocab(_docs(spark, d), "text"), 5)


def q_accuracy(spark, d):
    return ME.accuracy(_labels_pred(spark, d))


def q_evaluate(spark, d):
    pred = _labels_pred(spark, d)
    value = ME.evaluate(pred, "accuracy")
    return pred.agg(F.lit(round(value, 6)).alias("accuracy"))


def q_report(spark, d):
    return ME.report(_labels_pred(spark, d))


def q_rmse(spark, d):
    return ME.rmse(_labels_pred(spark, d))


def q_union_classes(spark, d):
    c = _corpus(spark, d).select("qid", "target")
    return SA.union_classes(FI.of_class(c, 0), FI.of_class(c, 1))


def q_balanced_sample(spark, d):
    return SA.balanced_sample(_corpus(spark, d), "target", 50, "qid").select("qid", "target")


def q_hash_split(spark, d):
    return SA.with_split(_corpus(spark, d), (0.6, 0.4), "qid", 24, "part").select("qid", "part")


def _text_key(fn):
    def q(spark, d):
        return _docs(spark, d).select("doc_id", fn(F.col("text")).alias("text"))
    return q


q_trim_text = _text_key(T.trim_text)
q_ascii_only = _text_key(T.ascii_only)
q_clean_punct_a = _text_key(lambda c: T.clean_punct(c, "a"))
q_clean_punct_b = _text_key(lambda c: T.clean_punct(c, "b"))
q_mask_numbers = _text_key(T.mask_numbers)
q_fix_misspellings = _text_key(lambda c: T.fix_misspellings(F.concat(c, F.lit(MISSPELLING_PROBE))))


def q_clean_corpus(spark, d):
    return PL.clean_corpus(_corpus(spark, d), "tuning")


def q_clean_corpus_main(spark, d):
    return PL.clean_corpus(_corpus(spark, d), "main")


def q_clean_corpus_notebook(spark, d):
    return PL.clean_corpus(_corpus(spark, d), "notebook")


def q_clean_corpus_explore(spark, d):
    docs = _docs(spark, d).withColumn("text", F.concat("text", F.lit(MISSPELLING_PROBE)))
    return PL.clean_corpus(docs, "explore", "text")


def q_to_label(spark, d):
    lab = TB.table(spark, d, "labels")
    return lab.select("doc_id", T.to_label(F.col("toxic").cast("string")).alias("label"))


def q_parse_vector(spark, d):
    ft = TB.feature_text(spark, d)
    return _long(ft, ["vec_id"], A.parse_vector("topics"))


def q_parse_vector_strict(spark, d):
    ft = TB.feature_text(spark, d)
    return _long(ft, ["vec_id"], A.parse_vector("topics", strict=True))


def q_take_items(spark, d):
    ft = TB.feature_text(spark, d)
    return _long(ft, ["vec_id"], A.take_items(A.parse_vector("topics"), 1, 19))


def q_pad_slots(spark, d):
    emb = TB.table(spark, d, "embeddings")
    return _long(emb, ["vec_id"], A.pad_slots("embedding", F.col("label") % 2, 2))


def q_to_vector(spark, d):
    emb = TB.table(spark, d, "embeddings")
    return _long(emb, ["vec_id"], A.vector_items(A.to_vector("embedding"), "float32"))


def q_feature_arrays(spark, d):
    fv = _feature_vectors(spark, d)
    return _long(fv, ["vec_id", "label"], A.vector_items("features"))


def q_tokenize(spark, d):
    return _long(_tokens(spark, d), ["doc_id"], F.col("words")).withColumnRenamed("value", "token")


def q_remove_stop_words(spark, d):
    f = FE.remove_stop_words(_tokens(spark, d), "words", "filtered")
    return _long(f, ["doc_id"], F.col("filtered")).withColumnRenamed("value", "token")


def q_term_counts(spark, d):
    return FE.term_count_rows(_main_tokens(spark, d), "qid")


def q_idf(spark, d):
    return FE.idf_rows(_main_tokens(spark, d)).withColumn("idf", F.round("idf", 6))


def q_tf_idf(spark, d):
    return FE.tf_idf_rows(_main_tokens(spark, d), "qid").withColumn("tfidf", F.round("tfidf", 6))


def q_word_vector_vocab(spark, d):
    return FE.counted_words(_main_tokens(spark, d)).select("word")


def q_word_vector_tables(spark, d):
    """Vectors by tables, with the weight of each word's neighbours (times the window of 5)."""
    rows = TI.numbered(_main_tokens(spark, d).select("filtered"))  # the fit and the pairs read the same tokens
    words = WT.fit_word_tables(rows)
    # told apart by numbers, which are smaller than words; written so that the numbers stay
    terms = lineage_cut(words.select("term", F.monotonically_increasing_id().alias("index")))
    pairs = WT.neighbour_pairs(rows, terms, "filtered", 5)
    near = pairs.groupBy(F.col("a").alias("index")).agg(F.round(F.sum(F.col("weight").cast("double")) * 5).cast("long").alias("near"))
    near = near.join(terms, "index").select("term", "near")
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return words.join(near, "term", "left").select(F.col("term").alias("word"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("near"),
                                                   F.size("vector").cast("long").alias("width"), finite.alias("is_finite"))


def q_explore_vector_vocab(spark, d):
    """Words with a vector in the exploration: count 4 at least, stop words kept."""
    docs = PL.clean_corpus(_docs(spark, d), "explore", "text")
    return FE.counted_words(FE.tokenize(docs, "text", "words"), "words", 4)


# --- sources: what was written is read back ---


def _written(spark):
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def q_lexicon_binary(spark, d):
    """The lexicon with vectors in the binary format, and back: each word with the ends of its vector."""
    W2.register(spark)
    path = _written(spark)
    words = TB.lexicon(spark, d).select("word", F.array(F.length("word").cast("float"), F.lit(0.5).cast("float"), F.lit(-1.25).cast("float")).alias("vector"))
    words.write.format("word2vec").mode("append").save(path)
    return SC.read_lexicon(spark, path, fmt="word2vec").select("word", F.col("vector")[0].alias("first"), F.col("vector")[2].alias("last"))


def _exported(spark, d, fmt):
    arrays = TB.feature_text(spark, d).select("vec_id", "target", A.parse_vector("topics", strict=True).alias("topics"))
    path = _written(spark)
    SC.export_features(arrays, path, fmt, text_vectors=fmt == "csv")
    return SC.read_export(spark, path)


def q_export_parquet(spark, d):
    return _long(_exported(spark, d, "parquet"), ["vec_id", "target"], F.col("topics"))


def q_export_csv(spark, d):
    back = _exported(spark, d, "csv")
    return _long(back.select(F.col("vec_id").cast("long"), F.col("target").cast("int"), A.parse_vector("topics", strict=True).alias("topics")),
                 ["vec_id", "target"], F.col("topics"))


def q_rejected_rows(spark, d):
    """The labels as lines, some of them spoilt: each with the reason why it is rejected, if it is."""
    lab = TB.table(spark, d, "labels", ["doc_id", "toxic"])
    line = F.when(F.col("doc_id") % 11 == 0, F.concat_ws(",", "doc_id", F.lit("some text"))).when(
        F.col("doc_id") % 7 == 0, F.concat_ws(",", "doc_id", F.lit("text"), F.lit("yes"))).otherwise(
        F.concat_ws(",", "doc_id", F.lit('"a ""quoted"", text"'), F.col("toxic").cast("string")))
    path = _written(spark)
    lab.select(line.alias("value")).write.text(path)
    good, bad = SC.read_checked(spark, path, columns=["qid", "question_text", "target"])
    kept = good.select(F.col("qid").cast("long").alias("doc_id"), "question_text", "target", F.lit("").alias("reason"))
    gone = bad.select(F.split("record", ",")[0].cast("long").alias("doc_id"), F.lit(None).cast("string").alias("question_text"),
                      F.lit(None).cast("int").alias("target"), "reason")
    return kept.unionByName(gone)


# --- model keys ---------------------------------------------------------------


def _mean_check(model, out, key, col):
    """Each document's vector against the mean of its words' vectors, first and
    last component: ``(key, width, n_tokens, n_known, is_mean)``."""
    words = model.getVectors().select("word", A.vector_items("vector", "float64").alias("x"))
    words = words.select("word", F.element_at("x", 1).alias("x0"), F.element_at("x", -1).alias("x1"))
    sums = (out.select(key, F.explode(col).alias("word")).join(words, "word").groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_known"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1")))
    got = out.select(key, F.size(col).cast("long").alias("n_tokens"), A.vector_items("wordvectors", "float64").alias("v"))
    near = lambda i, x: F.abs(F.element_at("v", i) * F.col("n_tokens") - F.coalesce(x, F.lit(0.0))) < 1e-3
    return got.join(sums, key, "left").select(
        key, F.size("v").cast("long").alias("width"), "n_tokens", F.coalesce("n_known", F.lit(0)).alias("n_known"),
        ((F.col("n_tokens") == 0) | (near(1, "x0") & near(-1, "x1"))).alias("is_mean"))


def q_word_vectors(spark, d):
    return _mean_check(*FE.word_vectors(_main_tokens(spark, d), "qid"), "qid", "filtered")


def q_explore_word_vectors(spark, d):
    docs = PL.clean_corpus(_docs(spark, d), "explore", "text")
    tokens = FE.tokenize(docs, "text", "words").select("doc_id", "words")  # the text isn't written with each step
    return _mean_check(*FE.word_vectors(tokens, "doc_id", "words", min_count=4), "doc_id", "words")


def q_assemble(spark, d):
    _, feats = _lda_input(spark, d)
    _, w = FE.word_vectors(feats, "qid")
    out = FE.assemble(w.drop("features"), ["wordvectors", "rawFeatures"], "features")
    return out.select("qid", A.vector_size("features").cast("long").alias("width"))


def q_term_vectors(spark, d):
    """The vectors that models read, by their terms' numbers: counts and weights as rows."""
    index, feats = _lda_input(spark, d)
    counts = TI.vector_rows(feats, index, "qid", "rawFeatures", "tf")
    weights = TI.vector_rows(feats, index, "qid", "features", "tfidf")
    return counts.join(weights, ["qid", "term"]).select("qid", "term", F.col("tf").cast("long").alias("tf"), F.round("tfidf", 6).alias("tfidf"))


def q_term_index(spark, d):
    index = TI.fit_term_index(TI.numbered(_main_tokens(spark, d)))
    return index.table.select("term", "index", "n", "doc_freq")


def q_topic_tables(spark, d):
    """The main model with its topics as a table: per class of documents its number of terms, whether
    the bound is below zero, whether the topics are distributions over the vocabulary, and whether the weights add up."""
    index, feats = _lda_input(spark, d)
    docs = TT.term_rows(feats, "features", "target")
    tables = TT.fit_topic_tables(feats, index.size, (K_MAIN,), "target", max_iter=SWEEP_ITER, docs=docs)
    scored = TT.likelihood(docs, tables)
    sums = {g: float(s.min()) for g, s in tables.sums.items()}
    rows = tables.rows.groupBy("grp").agg(F.count(F.lit(1)).alias("terms"), F.min(F.array_min("w")).alias("least"))
    eta = float(tables.eta.min())
    return scored.join(rows, "grp").select(F.col("grp").alias("label"), "terms", F.round("weight", 2).alias("weight"),
                                           ((F.col("log_likelihood") < 0) & (F.col("least") >= eta * (1 - 1e-9)) & F.lit(min(sums.values()) > 0)).alias("valid"))


def q_topic_mixture(spark, d):
    _, feats = _lda_input(spark, d)
    model = TO.topic_model(feats, "qid", K_MAIN)
    mixed = TO.topic_mixture(model, feats)
    arr = A.vector_items("topicDistribution", "float64")
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    moved = TT.residual(mixed, "qid", TT.of_model(model)).withColumnRenamed("qid", "id")
    return mixed.select("qid", F.size(arr).cast("long").alias("k"), F.round(total, 3).alias("total")).join(
        moved, F.col("qid") == F.col("id")).select(
        # inference must have ended there: a further step moves the mixture no more
        "qid", "k", "total", F.coalesce(F.col("residual") < 2 * TT.CLOSE, F.lit(True)).alias("is_fixed_point"))


def q_topic_terms(spark, d):
    index, feats = _lda_input(spark, d)
    model = TO.topic_model(feats, "qid", K_MAIN)
    # the terms against a vocabulary that is counted, not fitted
    counted = FE.counted_words(_main_tokens(spark, d), min_count=1).select(F.col("word").alias("term"), F.lit(True).alias("in_vocabulary"))
    terms = TO.topic_terms(model, index.table.select("index", "term"), 5).join(counted, "term", "left")
    return terms.select("in_vocabulary", F.col("topic").cast("long").alias("topic"),
                        F.col("rank").cast("long").alias("rank"),
                        (F.col("weight") > 0).alias("positive"))


def q_topics_explore(spark, d):
    """One LDA over all documents after the exploration cleaning, on tokens
    without stop-word removal."""
    docs = PL.clean_corpus(_docs(spark, d), "explore", "text")
    tok = FE.tokenize(docs, "text", "words")
    _, feats = PC.tfidf_features(tok, "words")
    mixed = TO.topic_mixture(TO.topic_model(feats, "doc_id", K_CLASS), feats)
    arr = A.vector_items("topicDistribution", "float64")
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return mixed.select("doc_id", F.size(arr).cast("long").alias("k"), F.round(total, 3).alias("total"))


def q_topics_by_class(spark, d):
    _, feats = _lda_input(spark, d)
    _, out = TO.topics_by_class(feats, "qid", "target", (0, 1), k=K_CLASS)
    first = F.slice("topic", 1, K_CLASS)
    zero_first = F.forall(first, lambda x: x == 0)
    return out.select("qid", "target", F.size("topic").cast("long").alias("width"),
                      zero_first.alias("first_half_zero"))


def q_class_topic_features(spark, d):
    """The notebook flow: word vectors, and each class's mixture in its half."""
    from textflow.plans.export import class_topic_features
    out = class_topic_features(_corpus(spark, d))
    total = F.aggregate(F.transform("topic", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    own = F.when(F.col("target") == 0, F.slice("topic", K_CLASS + 1, K_CLASS)).otherwise(F.slice("topic", 1, K_CLASS))
    return out.select("qid", "target", A.vector_size("wordvectors").cast("long").alias("width"),
                      F.size("topic").cast("long").alias("topics"), F.round(total, 3).alias("total"),
                      F.forall(own, lambda x: x == 0).alias("other_half_zero"))


def _scores(sweep):
    """The weight that the two scores of a fit imply."""
    implied = -F.col("log_likelihood") / F.col("log_perplexity")
    return sweep.select("label", "k", F.round(implied, 2).alias("weight"), (F.col("log_likelihood") < 0).alias("negative"))


def q_topic_sweep(spark, d):
    index, feats = _lda_input(spark, d)
    return _scores(TO.topic_sweep(feats, index.size, ks=SWEEP_KS, max_iter=SWEEP_ITER))


def q_topic_tuning(spark, d):
    from textflow.plans.export import topic_tuning
    return _scores(topic_tuning(_corpus(spark, d), ks=SWEEP_KS, max_iter=SWEEP_ITER))


# Per classifier: split, dropped value, and settings beside the defaults.
_CLASSIFIERS = {
    "random_forest": ((0.6, 0.4), 9, {"numTrees": 1000}),
    "perceptron": ((0.75, 0.25), 0, {}),
    "linear_svm": ((0.7, 0.3), 9, {}),
    "logistic": ((0.7, 0.3), 9, {}),
}


def _classified(spark, d, kind):
    weights, drop_value, params = _CLASSIFIERS[kind]
    return PC.classify_features(TB.feature_text(spark, d), kind, "vec_id", weights, 24, drop_value=drop_value, **params)


def _classifier_key(kind):
    return lambda spark, d: _model_check(_classified(spark, d, kind).predictions, "vec_id")


def _score_key(kind):
    def q(spark, d):
        run = _classified(spark, d, kind)
        return _score(run.models["classifier"], run.features)
    return q


q_random_forest, q_score_random_forest = _classifier_key("random_forest"), _score_key("random_forest")
q_perceptron, q_score_perceptron = _classifier_key("perceptron"), _score_key("perceptron")
q_linear_svm, q_score_linear_svm = _classifier_key("linear_svm"), _score_key("linear_svm")
q_logistic, q_score_logistic = _classifier_key("logistic"), _score_key("logistic")


def _tuned(spark, d):
    # written, as a dozen fits and the scores read the vectors
    data = lineage_cut(SA.with_split(_feature_vectors(spark, d), (0.7, 0.3), "vec_id", 24, "part"))
    est = MO.estimator("logistic")
    model, table = MO.tune(data.where(F.col("part") == 0), est, MO.logistic_grid(est), 0.8, "rmse")
    return model, table, data


def q_tune_logistic(spark, d):
    """Every setting with a score, and whether the best is exactly one: that
    with the smallest error, the first of equals."""
    _, table, _ = _tuned(spark, d)
    first = F.min(F.struct("score", "setting")).over(Window.partitionBy())["setting"]
    right = F.col("best") == (F.col("setting") == first)
    return table.select(F.col("setting").cast("long").alias("setting"), (F.col("score") >= 0).alias("scored"), right.alias("best_is_right"))


def q_score_tuned_logistic(spark, d):
    """The tuned model on the held-out part."""
    model, _, data = _tuned(spark, d)
    return _score(model, data)


def q_flagship(spark, d):
    return _model_check(PC.question_classifier(_corpus(spark, d)).predictions, "qid")


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)
# ---------------------------------------------------------------------------

_CORPUS = ("corpus AS (SELECT CAST(d.doc_id AS VARCHAR) AS qid, d.text AS question_text, "
           "l.toxic AS target FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")

# Python str.split() whitespace as an RE2 class.
_PYWS = r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _words(x):
    return f"list_filter(regexp_split_to_array({x}, '{_PYWS}'), lambda w: w <> '')"


_LEXICON = f"lexicon AS (SELECT DISTINCT unnest({_words('text')}) AS word FROM benchmark)"


def _trim(x):
    return f"rtrim(ltrim({x}, ' '), ' ')"


def _ascii(x):
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '', 'g')"


def _punct_a(x):
    return ("translate(replace(translate(" + x + ", '/-''', '   '), '&', ' punct '), "
            "'?!.,\"#$%''()*+:;<=>@[\\]^_`{|}~', '')")


def _punct_b(x):
    return ("translate(replace(translate(" + x + ", '/-''', '   '), '&', ' & '), "
            "'?!.,\"#$%''()*+-/:;<=>@[\\]^_`{|}~“”’', '')")


def _mask(x):
    return ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x +
            ", '[0-9]{5,}', '#####', 'g'), '[0-9]{4}', '####', 'g'), '[0-9]{3}', '###', 'g'), "
            "'[0-9]{2}', '##', 'g')")


# The misspellings, written out once more so that the oracle
# doesn't share the library's table.
_MISSPELL_RE = ("(colour|centre|didnt|doesnt|isnt|shouldnt|favourite|travelling|counselling|"
                "theatre|cancelled|labour|organisation|wwii|citicise|instagram|whatsapp|snapchat)")
_MISSPELL_CASE = ("CASE {m} WHEN 'colour' THEN 'color' WHEN 'centre' THEN 'center' "
                  "WHEN 'didnt' THEN 'did not' WHEN 'doesnt' THEN 'does not' WHEN 'isnt' THEN 'is not' "
                  "WHEN 'shouldnt' THEN 'should not' WHEN 'favourite' THEN 'favorite' "
                  "WHEN 'travelling' THEN 'traveling' WHEN 'counselling' THEN 'counseling' "
                  "WHEN 'theatre' THEN 'theater' WHEN 'cancelled' THEN 'canceled' WHEN 'labour' THEN 'labor' "
                  "WHEN 'organisation' THEN 'organization' WHEN 'wwii' THEN 'world war 2' "
                  "WHEN 'citicise' THEN 'criticize' WHEN 'instagram' THEN 'social medium' "
                  "WHEN 'whatsapp' THEN 'social medium' WHEN 'snapchat' THEN 'social medium' END")


def _misspell_sql(source, id_col, text_col):
    """One-pass replacement: pieces between matches, and the matches."""
    return (f"SELECT {id_col}, array_to_string(list_transform(pieces, lambda p, i: p || "
            f"coalesce({_MISSPELL_CASE.format(m='hits[i]')}, '')), '') AS {text_col} "
            f"FROM (SELECT {id_col}, regexp_split_to_array(t, '{_MISSPELL_RE}') AS pieces, "
            f"regexp_extract_all(t, '{_MISSPELL_RE}', 1) AS hits FROM ({source}))")


_PROBE_SQL = "'" + MISSPELLING_PROBE.replace("'", "''") + "'"

def _stop_words_sql():
    """A list that only the oracle reads: the operator takes Spark's default,
    and a test holds the two against each other."""
    from textflow.operators.stopwords import ENGLISH_STOP_WORDS
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + ")"


# Java's \s (the tokenizer's split), and the Tokenizer rule: lower-case,
# split on each whitespace character, trailing empty tokens dropped.
_JWS = r"[ \t\n\x0B\f\r]"


def _tokenize(x):
    return (f"CASE WHEN {x} = '' THEN [''] "
            f"WHEN rtrim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' "
            f"THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array(rtrim(lower({x}), chr(32) || chr(9) || chr(10) || chr(11) "
            f"|| chr(12) || chr(13)), '{_JWS}') END")


def _filtered(x):
    return f"list_filter({_tokenize(x)}, lambda w: lower(w) NOT IN {_stop_words_sql()})"


def _main_clean(x):
    return _mask(_punct_a(_trim(x)))


def _tuning_clean(x):
    return _mask(_punct_a(_trim(_ascii(x))))


_MAIN_TOKENS = (f"{_CORPUS}, toks AS (SELECT qid, target, {{filtered}} AS f FROM corpus "
                f"WHERE question_text <> '')")


def _main_tokens_cte():
    return _MAIN_TOKENS.format(filtered=_filtered(_main_clean("question_text")))


def _term_counts_sql():
    return (f"WITH {_main_tokens_cte()} "
            "SELECT qid, term, count(*)::BIGINT AS tf FROM (SELECT qid, unnest(f) AS term FROM toks) "
            "GROUP BY qid, term")


def _idf_cte():
    return (f"WITH {_main_tokens_cte()}, "
            "m AS (SELECT count(*) AS m FROM toks), "
            "dfq AS (SELECT term, count(*) AS doc_freq FROM (SELECT DISTINCT qid, unnest(f) AS term FROM toks) "
            "GROUP BY term), "
            "idf AS (SELECT term, doc_freq, ln((m.m + 1.0) / (doc_freq + 1.0)) AS idf FROM dfq, m)")


def _long_sql(source, ids, arr, value="value"):
    idl = ", ".join(ids)
    return (f"SELECT {idl}, (generate_subscripts(a, 1) - 1)::BIGINT AS pos, unnest(a) AS {value} "
            f"FROM (SELECT {idl}, {arr} AS a FROM ({source}))")


_FEATURE_TEXT = ("SELECT vec_id, (label % 2)::INTEGER AS target, '[' || array_to_string("
                 "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS INTEGER)::VARCHAR), "
                 "', ') || ']' AS topics FROM embeddings")


def _lenient(x):
    return f"list_transform(string_split({x}, ','), lambda p: TRY_CAST(p AS FLOAT))"


_STRICT = ("list_transform(string_split(regexp_replace(topics, '[\\[\\]]', '', 'g'), ','), "
           "lambda p: TRY_CAST(p AS FLOAT))")


def _take_1_18(arr):
    return f"list_transform(range(1, 19), lambda i: {arr}[i + 1])"


def _no_nine(arr):
    # array_contains(a, 9) = false: no 9 and no NULL item (NULL -> row dropped)
    return f"(NOT list_contains({arr}, 9::FLOAT) AND len(list_filter({arr}, lambda v: v IS NULL)) = 0)"


def _oracles() -> dict[str, str]:
    lab_pred = "SELECT doc_id, CAST(1 - quality AS DOUBLE) AS prediction, toxic AS label FROM labels"
    tuning_vocab = (f"WITH {_CORPUS}, {_LEXICON}, vocab AS (SELECT word, count(*) AS n FROM "
                    f"(SELECT unnest({_words(_tuning_clean('question_text'))}) AS word FROM corpus "
                    f"WHERE question_text <> '') GROUP BY word)")
    raw_vocab = (f"vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word "
                 f"FROM documents) GROUP BY word)")
    steps = [("raw", "text"), ("punct_b", _punct_b("text"))]
    steps.append(("numbers", _mask(steps[-1][1])))
    misspelled_src = f"SELECT doc_id, {steps[-1][1]} AS t FROM documents"
    o = {
        "scan_corpus": f"WITH {_CORPUS} SELECT qid, question_text, target FROM corpus",
        "rename_positional": "SELECT doc_id AS qid, quality, toxic AS target FROM labels",
        "as_labelled": f"SELECT target AS label, topics AS features FROM ({_FEATURE_TEXT})",
        "non_empty": (f"SELECT conv_id, turn FROM conversations WHERE {_ascii('text')} <> ''"),
        "of_class": f"WITH {_CORPUS} SELECT qid, target FROM corpus WHERE target = 1",
        "has_length": f"SELECT vec_id FROM ({_FEATURE_TEXT}) WHERE len({_lenient('topics')}) = 64",
        "without_value": (f"SELECT vec_id, target FROM (SELECT vec_id, target, {_take_1_18(_lenient('topics'))} "
                          f"AS a FROM ({_FEATURE_TEXT})) WHERE {_no_nine('a')}"),
        "build_vocab": f"WITH {raw_vocab} SELECT word, n FROM vocab",
        "lexicon_words": f"WITH {_LEXICON} SELECT word FROM lexicon",
        "known_words": f"{tuning_vocab} SELECT word, n FROM vocab WHERE word IN (SELECT word FROM lexicon)",
        "unknown_words": f"{tuning_vocab} SELECT word, n FROM vocab WHERE word NOT IN (SELECT word FROM lexicon)",
        "coverage": (f"{tuning_vocab} SELECT round(avg(CASE WHEN l.word IS NULL THEN 0 ELSE 1 END), 6) "
                     f"AS vocab_ratio, round(sum(CASE WHEN l.word IS NULL THEN 0 ELSE n END) / sum(n), 6) "
                     f"AS text_ratio FROM vocab v LEFT JOIN lexicon l ON v.word = l.word"),
        "oov_by_count": (f"{tuning_vocab} SELECT word, n FROM vocab WHERE word NOT IN "
                         f"(SELECT word FROM lexicon) ORDER BY n DESC, word"),
        "top_words": f"WITH {raw_vocab} SELECT word, n FROM vocab ORDER BY n DESC, word LIMIT 5",
        "accuracy": (f"SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) "
                     f"AS accuracy FROM ({lab_pred})"),
        "evaluate": (f"SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) "
                     f"AS accuracy FROM ({lab_pred})"),
        "rmse": f"SELECT round(sqrt(avg((prediction - label) ^ 2)), 6) AS rmse FROM ({lab_pred})",
        "report": (f"SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy, "
                   f"count(*) AS rows, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS positives, "
                   f"round(greatest(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), "
                   f"count(*) - sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)) / count(*), 6) AS majority_share "
                   f"FROM ({lab_pred})"),
        "union_classes": (f"WITH {_CORPUS} SELECT qid, target FROM corpus WHERE target = 0 "
                          f"UNION ALL SELECT qid, target FROM corpus WHERE target = 1"),
        "balanced_sample": (f"WITH {_CORPUS} SELECT qid, target FROM (SELECT qid, target, row_number() "
                            f"OVER (PARTITION BY target ORDER BY substr(md5(qid), 1, 16), qid) AS r "
                            f"FROM corpus) WHERE r <= 50 ORDER BY qid"),
        "hash_split": (f"WITH {_CORPUS} SELECT qid, CASE WHEN substr(md5(qid || ':24'), 1, 8) < '99999999' "
                       f"THEN 0 ELSE 1 END AS part FROM corpus"),
        "trim_text": f"SELECT doc_id, {_trim('text')} AS text FROM documents",
        "ascii_only": f"SELECT doc_id, {_ascii('text')} AS text FROM documents",
        "clean_punct_a": f"SELECT doc_id, {_punct_a('text')} AS text FROM documents",
        "clean_punct_b": f"SELECT doc_id, {_punct_b('text')} AS text FROM documents",
        "mask_numbers": f"SELECT doc_id, {_mask('text')} AS text FROM documents",
        "fix_misspellings": _misspell_sql(f"SELECT doc_id, text || {_PROBE_SQL} AS t FROM documents",
                                          "doc_id", "text"),
        "clean_corpus": (f"WITH {_CORPUS} SELECT qid, {_tuning_clean('question_text')} AS question_text, "
                         f"target FROM corpus WHERE question_text <> ''"),
        "clean_corpus_main": (f"WITH {_CORPUS} SELECT qid, {_main_clean('question_text')} AS question_text, "
                              f"target FROM corpus WHERE question_text <> ''"),
        "clean_corpus_notebook": (f"WITH {_CORPUS} SELECT qid, {_punct_a(_trim(_ascii('question_text')))} "
                                  f"AS question_text, target FROM corpus WHERE question_text <> ''"),
        "clean_corpus_explore": _misspell_sql(
            f"SELECT doc_id, {_mask(_punct_b('text || ' + _PROBE_SQL))} AS t FROM documents", "doc_id", "text"),
        "to_label": "SELECT doc_id, TRY_CAST(CAST(toxic AS VARCHAR) AS INTEGER) AS label FROM labels",
        "parse_vector": _long_sql(_FEATURE_TEXT, ["vec_id"], _lenient("topics")),
        "parse_vector_strict": _long_sql(
            _FEATURE_TEXT, ["vec_id"],
            "list_transform(string_split(regexp_replace(topics, '[\\[\\]]', '', 'g'), ','), "
            "lambda p: TRY_CAST(p AS FLOAT))"),
        "take_items": _long_sql(_FEATURE_TEXT, ["vec_id"], _take_1_18(_lenient("topics"))),
        "pad_slots": _long_sql(
            "SELECT vec_id, label, embedding FROM embeddings", ["vec_id"],
            "CASE WHEN label % 2 = 0 THEN list_concat(embedding, list_transform(range(len(embedding)), "
            "lambda i: 0::FLOAT)) ELSE list_concat(list_transform(range(len(embedding)), lambda i: 0::FLOAT), "
            "embedding) END"),
        "to_vector": _long_sql("SELECT vec_id, embedding FROM embeddings", ["vec_id"], "embedding"),
        "topics_explore": _topics_explore_sql(),
        "feature_arrays": _long_sql(
            f"SELECT vec_id, target AS label, a FROM (SELECT vec_id, target, "
            f"{_take_1_18(_lenient('topics'))} AS a FROM ({_FEATURE_TEXT})) WHERE len(a) = 18 AND {_no_nine('a')}",
            ["vec_id", "label"], "a"),
        "tokenize": _long_sql("SELECT doc_id, text FROM documents", ["doc_id"], _tokenize("text"), "token"),
        "remove_stop_words": _long_sql("SELECT doc_id, text FROM documents", ["doc_id"],
                                       _filtered("text"), "token"),
        "term_counts": _term_counts_sql(),
        "idf": f"{_idf_cte()} SELECT term, doc_freq, round(idf, 6) AS idf FROM idf",
        "tf_idf": (f"{_idf_cte()}, tc AS (SELECT qid, term, count(*) AS tf FROM "
                   f"(SELECT qid, unnest(f) AS term FROM toks) GROUP BY qid, term) "
                   f"SELECT qid, tc.term, round(tf * idf.idf, 6) AS tfidf FROM tc JOIN idf ON tc.term = idf.term"),
        "term_vectors": (f"{_idf_cte()}, tc AS (SELECT qid, term, count(*)::BIGINT AS tf FROM "
                         f"(SELECT qid, unnest(f) AS term FROM toks) GROUP BY qid, term) "
                         f"SELECT qid, tc.term, tf, round(tf * idf.idf, 6) AS tfidf FROM tc JOIN idf ON tc.term = idf.term"),
        "term_index": (f"{_idf_cte()}, c AS (SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(f) AS term FROM toks) GROUP BY term) "
                       f"SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS index, n, doc_freq FROM c JOIN dfq USING (term)"),
        "topic_tables": _weights_sql(f"WITH {_main_tokens_cte()}", (0,)).replace(
            "k::INTEGER AS k, ", "(SELECT count(*) FROM dfq)::BIGINT AS terms, ").replace("AS negative", "AS valid"),
        "lexicon_binary": f"WITH {_LEXICON} SELECT word, length(word)::FLOAT AS first, -1.25::FLOAT AS last FROM lexicon",
        "export_parquet": _long_sql(_FEATURE_TEXT, ["vec_id", "target"], _STRICT),
        "export_csv": _long_sql(_FEATURE_TEXT, ["vec_id", "target"], _STRICT),
        "rejected_rows": ("SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN 'a \"quoted\", text' END AS question_text, "
                          "CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN toxic::INTEGER END AS target, "
                          "CASE WHEN doc_id % 11 = 0 THEN 'columns' WHEN doc_id % 7 = 0 THEN 'type of target' ELSE '' END AS reason FROM labels"),
        "word_vector_vocab": (f"WITH {_main_tokens_cte()} SELECT term AS word FROM "
                              f"(SELECT unnest(f) AS term FROM toks) GROUP BY term HAVING count(*) >= 2"),
        "word_vector_tables": (f"WITH {_main_tokens_cte()}, u AS (SELECT qid, unnest(f) AS term, unnest(range(len(f))) AS i FROM toks), "
                               f"c AS (SELECT term, count(*) AS n FROM u GROUP BY term HAVING count(*) >= 2), "
                               f"k AS (SELECT term, n, row_number() OVER (PARTITION BY qid ORDER BY i) AS p, count(*) OVER (PARTITION BY qid) AS l "
                               f"FROM u JOIN c USING (term)), "
                               f"d AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS d FROM k) "
                               f"SELECT term AS word, n, sum((6 - d) * ((p > d)::INT + (p + d <= l)::INT))::BIGINT AS near, "
                               f"100::BIGINT AS width, true AS is_finite FROM d GROUP BY term, n"),
        "explore_vector_vocab": f"{_explore_tokens_cte()} SELECT word, n FROM counted WHERE n >= 4",
        # --- model outputs ---
        "word_vectors": (f"WITH {_main_tokens_cte()}, w AS (SELECT qid, unnest(f) AS word FROM toks), "
                         f"counted AS (SELECT word, count(*) AS n FROM w GROUP BY word) {_KNOWN_TOKENS.format(key='qid', least=2)}"),
        "explore_word_vectors": f"{_explore_tokens_cte()} {_KNOWN_TOKENS.format(key='doc_id', least=4)}",
        "assemble": (f"WITH {_main_tokens_cte()} SELECT qid, (100 + (SELECT count(DISTINCT t) FROM "
                     f"(SELECT unnest(f) AS t FROM toks)))::BIGINT AS width FROM toks"),
        "topic_mixture": (f"WITH {_main_tokens_cte()} SELECT qid, {K_MAIN}::BIGINT AS k, "
                          f"CASE WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total, true AS is_fixed_point FROM toks"),
        "topic_terms": (f"WITH {_main_tokens_cte()}, v AS (SELECT DISTINCT unnest(f) AS term FROM toks) "
                        f"SELECT t::BIGINT AS topic, r::BIGINT AS rank, true AS positive, true AS in_vocabulary "
                        f"FROM range({K_MAIN}) a(t), range(5) b(r) WHERE r < (SELECT count(*) FROM v)"),
        "topics_by_class": (f"WITH {_main_tokens_cte()} SELECT qid, target, {2 * K_CLASS}::BIGINT AS width, "
                            f"target = 1 OR len(f) = 0 AS first_half_zero FROM toks"),
        "class_topic_features": (
            f"WITH {_MAIN_TOKENS.format(filtered=_filtered(_punct_a(_trim(_ascii('question_text')))))} SELECT qid, target, "
            f"100::BIGINT AS width, {2 * K_CLASS}::BIGINT AS topics, CASE WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total, "
            f"true AS other_half_zero FROM toks"),
        "topic_sweep": _weights_sql(f"WITH {_main_tokens_cte()}"),
        # the sample takes 10,000 rows of a class: here all of them
        "topic_tuning": _weights_sql("WITH " + _MAIN_TOKENS.format(filtered=_filtered(_tuning_clean("question_text")))),
        "random_forest": _model_sql((0.6,), 9),
        "perceptron": _model_sql((0.75,), 0),
        "linear_svm": _model_sql((0.7,), 9),
        "logistic": _model_sql((0.7,), 9),
        "score_random_forest": _score_sql((0.6,), 9),
        "score_perceptron": _score_sql((0.75,), 0),
        "score_linear_svm": _score_sql((0.7,), 9),
        "score_logistic": _score_sql((0.7,), 9),
        "score_tuned_logistic": _score_sql((0.7,), 9),
        "tune_logistic": "SELECT s::BIGINT AS setting, true AS scored, true AS best_is_right FROM range(12) a(s)",
        "flagship": (f"WITH {_main_tokens_cte()} SELECT qid, target AS label, true AS valid FROM toks WHERE "
                     f"substr(md5(qid || ':24'), 1, 8) >= '99999999'"),
    }
    o["coverage_by_step"] = _coverage_by_step_sql(steps, misspelled_src)
    return o


# Documents with their tokens, those whose word is counted often enough, and
# a vector that is the mean of the known tokens' vectors.
_KNOWN_TOKENS = ("SELECT {key}, 100::BIGINT AS width, len(f)::BIGINT AS n_tokens, "
                 "coalesce(k, 0)::BIGINT AS n_known, true AS is_mean FROM toks LEFT JOIN "
                 "(SELECT {key}, count(*) AS k FROM w JOIN counted USING (word) WHERE n >= {least} GROUP BY {key}) USING ({key})")


def _explore_tokens_cte():
    src = f"SELECT doc_id, {_mask(_punct_b('text'))} AS t FROM documents"
    return (f"WITH c AS ({_misspell_sql(src, 'doc_id', 'text')}), "
            f"toks AS (SELECT doc_id, {_tokenize('text')} AS f FROM c), w AS (SELECT doc_id, unnest(f) AS word FROM toks), "
            f"counted AS (SELECT word, count(*) AS n FROM w GROUP BY word)")


def _topics_explore_sql():
    return (f"{_explore_tokens_cte()} SELECT doc_id, {K_CLASS}::BIGINT AS k, "
            f"CASE WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total FROM toks")


def _weights_sql(tokens, ks=None):
    """Per class the sum of its TF-IDF weights, whatever the number of topics."""
    return (f"{tokens}, m AS (SELECT count(*) AS m FROM toks), "
            "dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT qid, unnest(f) AS term FROM toks) GROUP BY term), "
            "u AS (SELECT target, unnest(f) AS term FROM toks), "
            "s AS (SELECT target, sum(ln((m.m + 1.0) / (df + 1.0))) AS weight FROM u JOIN dfq USING (term), m GROUP BY target) "
            f"SELECT target::INTEGER AS label, k::INTEGER AS k, round(weight, 2) AS weight, true AS negative "
            f"FROM s, (VALUES {', '.join(f'({k})' for k in (SWEEP_KS if ks is None else ks))}) r(k)")


def _held_out_sql(train_share, drop_value):
    bound = format(min(int(train_share[0] * 16 ** 8), 16 ** 8 - 1), "08x")
    return (f"SELECT vec_id, target AS label FROM (SELECT vec_id, target, {_take_1_18(_lenient('topics'))} AS a "
            f"FROM ({_FEATURE_TEXT})) WHERE len(a) = 18 AND "
            f"(NOT list_contains(a, {drop_value}::FLOAT) AND len(list_filter(a, lambda v: v IS NULL)) = 0) "
            f"AND substr(md5(CAST(vec_id AS VARCHAR) || ':24'), 1, 8) >= '{bound}'")


def _model_sql(train_share, drop_value):
    return f"SELECT vec_id, label, true AS valid FROM ({_held_out_sql(train_share, drop_value)})"


def _score_sql(train_share, drop_value):
    return (f"SELECT count(*)::BIGINT AS rows, sum(label)::BIGINT AS positives, "
            f"round(greatest(sum(label), count(*) - sum(label)) / count(*), 6) AS majority_share, true AS scores_agree, "
            f"true AS learns FROM ({_held_out_sql(train_share, drop_value)})")


def _coverage_by_step_sql(steps, misspelled_src):
    parts = [f"SELECT {i} AS step, '{name}' AS name, unnest({_words(expr)}) AS word FROM documents"
             for i, (name, expr) in enumerate(steps)]
    parts.append(f"SELECT 3 AS step, 'misspellings' AS name, unnest({_words('text')}) AS word FROM "
                 f"({_misspell_sql(misspelled_src, 'doc_id', 'text')})")
    return (f"WITH {_LEXICON}, v AS (SELECT step, name, word, count(*) AS n FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY step, name, word) "
            "SELECT step, name, round(avg(CASE WHEN l.word IS NULL THEN 0 ELSE 1 END), 6) AS vocab_ratio, "
            "round(sum(CASE WHEN l.word IS NULL THEN 0 ELSE n END) / sum(n), 6) AS text_ratio "
            "FROM v LEFT JOIN lexicon l ON v.word = l.word GROUP BY step, name")


# ---------------------------------------------------------------------------
# Contract
# ---------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship on sf0.001: the whole question classifier with the original
    settings (main cleaning, Word2Vec 100 wide / minCount 2, term counts,
    TF-IDF, LDA k=8 x 100 iterations, forest of 10 trees, 60/40 split with
    seed 24): predictions ``(qid, prediction, label)`` on the test part."""
    return PC.question_classifier(TB.corpus(spark, FLAGSHIP_SF)).predictions


def _llm_queries() -> tuple[dict, dict]:
    """Queries and oracles of ``textflow.llm`` and of the corpus pipeline; none
    where these folders aren't there."""
    try:
        import corpus_pipeline
        from textflow.llm import registry
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "textflow.llm"):
            raise
        return {}, {}
    oracles = dict(registry.oracle_sql())
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return registry.queries() | {"pipeline": corpus_pipeline.run}, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = globals()
    own = {name[2:]: fn for name, fn in g.items() if name.startswith("q_") and callable(fn)}
    return own | _llm_queries()[0]


def oracle_sql() -> dict[str, str]:
    return _oracles() | _llm_queries()[1]
