"""Cleaning expressions: hand-made cases, and random strings against the
rules restated in plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyrules as R
from textflow.functions import text as T

ALPHABET = ("abcdeiorstwxyzACE 0123456789\t\n?!.,\"#$%'()*+:;<=>@[\\]^_`{|}~/-&"
            "“”’éçü€漢")
FRAGMENTS = ["colour", "wwii", "isnt", "snt", "didnt", "labour", "centre", "whatsapp", "12345",
             "99", " & ", "R&D", "don't", "well-known"]
text = st.lists(st.one_of(st.text(ALPHABET, max_size=12), st.sampled_from(FRAGMENTS)),
                max_size=8).map("".join)


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", fn(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_hand_cases(spark):
    assert apply(spark, lambda c: T.clean_punct(c, "a"), ["R&D"]) == ["R punct D"]
    assert apply(spark, lambda c: T.clean_punct(c, "b"), ["R&D"]) == ["R & D"]
    assert apply(spark, lambda c: T.clean_punct(c, "a"), ["don't well-known"]) == ["don t well known"]
    assert apply(spark, T.mask_numbers, ["1 12 123 1234 123456"]) == ["1 ## ### #### #####"]
    assert apply(spark, T.ascii_only, ["café"]) == ["caf"]
    assert apply(spark, T.trim_text, [" \ta "]) == ["\ta"]
    assert apply(spark, T.fix_misspellings, ["wwiisnt"]) == ["world war 2snt"]
    assert apply(spark, T.fix_misspellings, ["colours"]) == ["colors"]
    assert apply(spark, T.fix_misspellings, ["Colour isnt"]) == ["Colour is not"]
    assert apply(spark, T.fix_misspellings, [None]) == [None]
    assert apply(spark, T.words_of, ["  a\tb c\x1c d  "]) == [["a", "b", "c", "d"]]
    assert apply(spark, T.to_label, ["1", "0", "x", None]) == [1, 0, None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text, min_size=20, max_size=40))
def test_rules_match_python(spark, values):
    cases = [
        (T.trim_text, R.trim),
        (T.ascii_only, R.ascii_only),
        (lambda c: T.clean_punct(c, "a"), lambda x: R.punct(x, "a")),
        (lambda c: T.clean_punct(c, "b"), lambda x: R.punct(x, "b")),
        (T.mask_numbers, R.mask),
        (T.fix_misspellings, R.misspell),
        (T.words_of, R.words),
    ]
    for fn, py in cases:
        assert apply(spark, fn, values) == [py(v) for v in values]


def test_no_python_in_cleaning_plan(spark):
    from textflow.plans.cleaning import clean_corpus
    df = spark.createDataFrame([("1", "a&b 12345 colour", 1)], "qid string, question_text string, target int")
    for preset in ("main", "tuning", "notebook", "explore"):
        plan = clean_corpus(df, preset)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
