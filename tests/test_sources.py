"""The binary word-vector source, exports with a manifest, rejected rows."""

import os
import random
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.sources import corpus as SC
from textflow.sources import word2vec as W2


def scratch():
    return tempfile.mkdtemp(prefix="textflow-test-", dir="/tmp")


def binary(path, rows, width, newline):
    with open(path, "wb") as out:
        out.write(f"{len(rows)} {width}\n".encode())
        for word, vector in rows:
            out.write(word.encode() + b" " + struct.pack(f"<{width}f", *vector) + (b"\n" if newline else b""))


@pytest.mark.parametrize("newline", [True, False])
def test_binary_lexicon_in_any_number_of_parts(spark, newline):
    W2.register(spark)
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcé中-'") for _ in range(rng.randint(1, 12))) + str(i), [rng.uniform(-1, 1) for _ in range(7)]) for i in range(700)]
    path = os.path.join(scratch(), "v.bin")
    binary(path, rows, 7, newline)
    want = [(w, np.array(v, np.float32).tolist()) for w, v in rows]
    for size in (1 << 20, 5000, 613):
        df = spark.read.format("word2vec").option("partitionBytes", size).load(path)
        assert sorted(map(tuple, df.collect())) == sorted(want), size
    assert df.rdd.getNumPartitions() > 30
    back = SC.read_lexicon(spark, path, fmt="word2vec", vectors=False)
    assert {r.word for r in back.collect()} == {w for w, _ in rows}


def test_binary_round_trip_empty_files_and_errors(spark):
    W2.register(spark)
    folder = scratch() + "/words"
    df = spark.createDataFrame([(f"w{i}", [float(i), -0.5]) for i in range(300)], "word string, vector array<float>").repartition(3)
    df.write.format("word2vec").mode("append").save(folder)
    assert sorted(map(tuple, spark.read.format("word2vec").load(folder).collect())) == sorted(map(tuple, df.collect()))
    assert all(name.startswith("part-") for name in os.listdir(folder))
    empty = os.path.join(scratch(), "none.bin")
    binary(empty, [], 5, True)
    assert spark.read.format("word2vec").load(empty).collect() == []
    cut = os.path.join(scratch(), "cut.bin")
    binary(cut, [("a", [1.0] * 5), ("b", [2.0] * 5)], 5, False)
    with open(cut, "r+b") as f:
        f.truncate(os.path.getsize(cut) - 3)
    with pytest.raises(Exception, match="record|meet"):
        spark.read.format("word2vec").load(cut).collect()


def test_exports_are_whole_versions(spark):
    path = scratch() + "/export"
    with pytest.raises(FileNotFoundError):
        SC.read_export(spark, path)
    a = spark.createDataFrame([(1, [0.5, 0.25]), (2, None)], "target int, topics array<double>")
    b = spark.createDataFrame([(3, [1.0])], "target int, topics array<double>")
    assert SC.export_features(a, path) == 1
    assert sorted(map(tuple, SC.read_export(spark, path).collect())) == [(1, [0.5, 0.25]), (2, None)]
    # a failed export: its table is there, its manifest isn't
    SC.write_features(b, path + "/data-half")
    assert SC.read_export(spark, path).count() == 2
    assert SC.export_features(b, path, "csv", text_vectors=True) == 2
    assert [tuple(r) for r in SC.read_export(spark, path).collect()] == [("3", "[1.0]")]
    assert SC.read_export(spark, path, 1).count() == 2
    folder = next(d for d in os.listdir(path) if d.startswith("data-") and any(f.endswith(".csv") for f in os.listdir(f"{path}/{d}")))
    part = next(f for f in os.listdir(f"{path}/{folder}") if f.endswith(".csv"))
    with open(f"{path}/{folder}/{part}", "a") as f:
        f.write("x\n")
    with pytest.raises(ValueError):
        SC.read_export(spark, path)


def test_rejected_rows_come_out_with_file_and_reason(spark):
    d = scratch()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('question_text,qid,target\n"hello, you",q1,1\nno target,q2,\nbad,q3,x\nshort,q4\nlong,q5,0,more\n')
    good, bad = SC.read_checked(spark, d)
    assert sorted(map(tuple, good.collect())) == [("q1", "hello, you", 1), ("q2", "no target", None)]
    rows = {r.record: (r.reason, os.path.basename(r.file)) for r in bad.collect()}
    assert rows == {"bad,q3,x": ("type of target", "a.csv"), "short,q4": ("columns", "a.csv"), "long,q5,0,more": ("columns", "a.csv")}
    assert good.where(F.col("target") == 1).count() == 1 and bad.count() == 3
