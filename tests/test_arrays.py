from pyspark.sql import functions as F

from textflow.functions import arrays as A
from textflow.operators import filters as FI


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first().y


def test_parse_vector(spark):
    assert one(spark, A.parse_vector("x"), "[0.1, 0.2, 0.3]") == [None, 0.20000000298023224, None]
    got = one(spark, A.parse_vector("x", strict=True), "[0.5, 0.25, 1]")
    assert got == [0.5, 0.25, 1.0]


def test_take_items_pads_with_null(spark):
    assert one(spark, A.take_items("x", 1, 4), [1, 2, 3], "x array<int>") == [2, 3, None]


def test_pad_slots(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 4.0], 1)], "x array<float>, s int")
    rows = df.select(A.pad_slots("x", F.col("s"), 2, 2).alias("y")).collect()
    assert [r.y for r in rows] == [[1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 3.0, 4.0]]


def test_vector_roundtrip_and_entries(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.sparse(5, [1, 3], [2.0, 7.0]),), (Vectors.dense([0.5, 1.5]),)],
                               ["v"])
    ent = [[(e["index"], e["value"]) for e in r.e] for r in df.select(A.vector_entries("v").alias("e")).collect()]
    assert ent == [[(1, 2.0), (3, 7.0)], [(0, 0.5), (1, 1.5)]]
    arr = df.select(A.vector_items("v", "float64").alias("a")).collect()
    assert arr[0].a == [0.0, 2.0, 0.0, 7.0, 0.0]
    back = df.select(A.to_vector(A.vector_items("v", "float64")).alias("w")).collect()
    assert back[1].w.toArray().tolist() == [0.5, 1.5]


def test_without_value_drops_nulls_too(spark):
    # quirk: array_contains is NULL for [1, NULL] -> row dropped
    df = spark.createDataFrame([([9.0, 1.0],), ([1.0, None],), ([1.0, 2.0],), ([9.0, None],), (None,)],
                               "a array<float>")
    assert [r.a for r in FI.without_value(df, "a", 9).collect()] == [[1.0, 2.0]]


def test_has_length_and_non_empty(spark):
    df = spark.createDataFrame([([1, 2],), ([1],), (None,)], "a array<int>")
    assert FI.has_length(df, "a", 2).count() == 1
    t = spark.createDataFrame([("",), (None,), (" ",), ("a",)], "t string")
    assert sorted(r.t for r in FI.non_empty(t, "t").collect()) == [" ", "a"]


def test_slice_skips_the_bracket_pieces(spark):
    # quirk: items 1..18 of a 20-item text vector are exactly the pieces
    # without brackets, so nothing is NULL after the slice
    text = "[" + ", ".join(str(i) for i in range(20)) + "]"
    got = one(spark, A.take_items(A.parse_vector("x"), 1, 19), text)
    assert got == [float(i) for i in range(1, 19)]


def test_parse_and_take_match_python(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    def py_parse(s):
        out = []
        for p in s.split(","):
            try:
                out.append(float(p))
            except ValueError:
                out.append(None)
        return out

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.integers(-100, 100), min_size=1, max_size=25), min_size=5, max_size=20))
    def check(vectors):
        texts = ["[" + ", ".join(map(str, v)) + "]" for v in vectors]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        rows = df.select("i", A.parse_vector("x").alias("p"),
                         A.take_items(A.parse_vector("x"), 1, 19).alias("t")).collect()
        for r in sorted(rows, key=lambda r: r.i):
            want = py_parse(texts[r.i])
            assert r.p == want
            assert r.t == [want[j] if j < len(want) else None for j in range(1, 19)]

    check()


def test_take_items_makes_its_array_once(spark):
    """The array is one input of the expression, not of each position; missing arrays and places are NULL."""
    df = spark.createDataFrame([(1, "a,b,c,d"), (2, "a,b"), (3, None)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", A.take_items(F.split("t", ","), 1, 4).alias("v")).collect()}
    assert got == {1: ["b", "c", "d"], 2: ["b", None, None], 3: [None, None, None]}
    plan = df.select(A.take_items(F.split("t", ","), 1, 4).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array(split(" in plan and "lambdafunction(split" not in plan
