import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from textflow.sources import corpus as SC
from textflow.sources import tables as TB


def scratch():
    return tempfile.mkdtemp(prefix="textflow-test-", dir="/tmp")


def test_csv_corpus_and_feature_roundtrip(spark):
    d = scratch()
    rows = [("q1", 'He said "hi", then\nleft', 0), ("q2", "R&D?", 1)]
    with open(os.path.join(d, "train.csv"), "w") as fh:
        fh.write("qid,question_text,target\n")
        for q, t, y in rows:
            fh.write(q + ',"' + t.replace('"', '""') + '",' + str(y) + "\n")
    got = SC.read_corpus(spark, os.path.join(d, "train.csv"), multiLine=True).orderBy("qid").collect()
    assert [tuple(r) for r in got] == rows
    assert SC.rename_positional(SC.read_corpus(spark, os.path.join(d, "train.csv")), "a", "b", "c").columns == \
        ["a", "b", "c"]

    ft = spark.createDataFrame([(1, [0.5, 0.25]), (0, [1.0, 2.0])], "target int, topics array<double>")
    SC.write_features(ft, os.path.join(d, "feat_csv"), fmt="csv", text_vectors=True)
    back = SC.read_features(spark, os.path.join(d, "feat_csv", "*.csv"), "topics", "target")
    assert sorted((r.target, r.topics) for r in back.collect()) == [(0, "[1.0, 2.0]"), (1, "[0.5, 0.25]")]
    legacy = SC.read_features(spark, os.path.join(d, "feat_csv", "*"), "topics", "target",
                              fmt="com.databricks.spark.csv")
    assert sorted(map(tuple, legacy.collect())) == sorted(map(tuple, back.collect()))
    SC.write_features(ft, os.path.join(d, "feat_pq"))
    back = SC.read_features(spark, os.path.join(d, "feat_pq"), "topics", "target", fmt="parquet")
    assert sorted((r.target, r.topics) for r in back.collect()) == [(0, [1.0, 2.0]), (1, [0.5, 0.25])]
    lab = SC.as_labelled(back, "target", "topics")
    assert lab.columns == ["label", "features"]


def test_lexicon_text_format(spark):
    d = scratch()
    with open(os.path.join(d, "lex.txt"), "w") as fh:
        fh.write("cat 0.1 0.2\ndog 0.3 0.4\ncat 0.1 0.2\n")
    lex = SC.read_lexicon(spark, os.path.join(d, "lex.txt"), fmt="text")
    rows = sorted((r.word, [round(x, 3) for x in r.vector]) for r in lex.collect())
    assert rows == [("cat", [0.1, 0.2]), ("dog", [0.3, 0.4])]
    with open(os.path.join(d, "odd.txt"), "w") as fh:
        fh.write("3 2\ncat 0.9 0.2\ncat 0.1 x\nlone\n")
    odd = {r.word: r.vector for r in SC.read_lexicon(spark, os.path.join(d, "odd.txt"), fmt="text").collect()}
    assert set(odd) == {"cat", "lone"} and odd["cat"][1] is None
    assert SC.read_lexicon(spark, os.path.join(d, "odd.txt"), fmt="text", vectors=False).columns == ["word"]


def test_csv_columns_are_picked_by_name(spark):
    d = scratch()
    with open(os.path.join(d, "odd.csv"), "w") as fh:
        fh.write("target,extra,qid,question_text\n1,x,a,hello\nbad,y,b,\"yes, \"\"you\"\"\"\n")
    got = SC.read_corpus(spark, os.path.join(d, "odd.csv")).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [("a", "hello", 1), ("b", 'yes, "you"', None)]


def test_a_large_csv_is_read_in_several_tasks(spark):
    d = scratch()
    with open(os.path.join(d, "large.csv"), "w") as fh:
        fh.write("qid,question_text,target\n")
        fh.writelines(f"q{i},{'word ' * 40},{i % 2}\n" for i in range(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = SC.read_corpus(spark, os.path.join(d, "large.csv"))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_class_topics_and_classify_back(spark):
    from textflow.plans import classify_features, export_class_topic_features
    d = scratch()
    back = export_class_topic_features(TB.corpus(spark, SF001), os.path.join(d, "export"), fmt="csv",
                                       text_vectors=True, k=3, max_iter=3, w2v_size=8, min_df=2.0)
    rows = back.collect()
    assert rows and all(r.topic.startswith("[") and len(r.topic.split(",")) == 6 for r in rows)
    # the feature-file classifier reads the exported text vectors
    ft = back.select("qid", F.col("target").cast("int").alias("target"), F.col("topic").alias("topics"))
    run = classify_features(ft, "logistic", key="qid", drop_value=None, start=0, stop=6, strict=True)
    held = run.features.where("part = 1").select("qid", "label")
    assert sorted(map(tuple, run.predictions.select("qid", "label").collect())) == sorted(map(tuple, held.collect())) != []
    table = spark.read.option("header", True).csv(os.path.join(d, "export"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows))
    assert {r.qid for r in rows} == {r.qid for r in TB.corpus(spark, SF001).collect()}
