"""The cleaning chains: a filter plus one projection per step.

Every step is a native expression, so a chain compiles into whole-stage
codegen right after the scan; the non-empty filter is a plain predicate that
Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (ascii_only, clean_punct, fix_misspellings,
                              mask_numbers, trim_text, words_of)
from ..operators.filters import non_empty
from ..operators.vocab import build_vocab

STEPS = {
    "trim": trim_text,
    "ascii": ascii_only,
    "punct_a": lambda c: clean_punct(c, "a"),
    "punct_b": lambda c: clean_punct(c, "b"),
    "numbers": mask_numbers,
    "misspellings": fix_misspellings,
}

# The chains of the four original scripts ("non_empty" is the row filter).
PRESETS = {
    "main": ("non_empty", "trim", "punct_a", "numbers"),
    "tuning": ("non_empty", "ascii", "trim", "punct_a", "numbers"),
    "notebook": ("non_empty", "ascii", "trim", "punct_a"),
    "explore": ("punct_b", "numbers", "misspellings"),
}


def clean_text(c, steps) -> Column:
    """The steps of a chain as one nested expression (the row filter
    excluded). ``clean_corpus`` applies the steps one projection at a time
    instead, so a step that reads its input twice never recomputes it."""
    x = F.col(c) if isinstance(c, str) else c
    for s in steps:
        if s != "non_empty":
            x = STEPS[s](x)
    return x


def clean_corpus(df: DataFrame, preset: str = "main", col: str = "question_text") -> DataFrame:
    """Clean the text column with one of the preset chains.

    Each step is its own projection of the previous step's column. Steps
    that test their input before rewriting it (digits, misspellings) read
    it twice, so Catalyst keeps those projections apart and every step runs
    once per row; the rest fuse into one codegen stage.
    """
    steps = PRESETS[preset] if isinstance(preset, str) else tuple(preset)
    if "non_empty" in steps:
        df = non_empty(df, col)
    for step in steps:
        if step != "non_empty":
            df = df.withColumn(col, STEPS[step](F.col(col)))
    return df


# Steps that act inside words: they never turn whitespace into a word
# character or delete whitespace, and their patterns hold no whitespace. For
# such steps, cleaning a text and splitting it gives the same words as
# splitting first and cleaning each word. The ASCII step is not one of them
# (it deletes non-ASCII spaces, which joins words).
WORD_LOCAL = frozenset({"trim", "punct_a", "punct_b", "numbers", "misspellings"})


def vocab_by_step(df: DataFrame, col: str = "question_text",
                  steps=("raw", "punct_b", "numbers", "misspellings")) -> DataFrame:
    """Word counts after each cumulative cleaning step:
    ``(step int, name string, word string, n bigint)``.

    When every step acts inside words (``WORD_LOCAL``), the text is scanned
    and counted once; each step then cleans and re-splits the distinct
    words, weighted by their counts, so the cleaning runs over the
    vocabulary instead of over every token. Otherwise each row carries its
    text at every step and the words are counted with one aggregate.
    """
    names = F.element_at(F.array(*[F.lit(n) for n in steps]), F.col("step") + 1)
    by_vocab = all(s in WORD_LOCAL for s in steps[1:])
    if by_vocab:
        # count the text once, then clean the distinct words
        src, col, weight = build_vocab(df, col).withColumnRenamed("word", "_w"), "_w", ["n"]
    else:
        src, weight = df, []
    # step i is computed from step i-1, one projection each (Catalyst keeps
    # them apart because each text is read twice), then one explode tags
    # the texts by step
    wide = src.select(F.col(col).alias("_t0"), *weight)
    for i, name in enumerate(steps[1:], 1):
        wide = wide.withColumn(f"_t{i}", STEPS[name](F.col(f"_t{i - 1}")))
    variants = [F.struct(F.lit(i).alias("step"), F.col(f"_t{i}").alias("t")) for i in range(len(steps))]
    tagged = wide.select(F.explode(F.array(*variants)).alias("s"), *weight)
    words = tagged.select("s.step", F.explode(words_of(F.col("s.t"))).alias("word"), *weight)
    n = F.sum("n") if by_vocab else F.count(F.lit(1))
    counted = words.groupBy("step", "word").agg(n.alias("n"))
    return counted.select("step", names.alias("name"), "word", "n")


def coverage_by_step(df: DataFrame, lexicon: DataFrame, col: str = "question_text",
                     steps=("raw", "punct_b", "numbers", "misspellings"), digits: int = 6) -> DataFrame:
    """Lexicon coverage after each cleaning step: ``(step, name,
    vocab_ratio, text_ratio)``."""
    v = vocab_by_step(df, col, steps)
    marked = v.join(lexicon.select("word", F.lit(1).alias("known")), "word", "left")
    k = F.coalesce(F.col("known"), F.lit(0))
    return marked.groupBy("step", "name").agg(
        F.round(F.sum(k) / F.count(F.lit(1)), digits).alias("vocab_ratio"),
        F.round(F.sum(k * F.col("n")) / F.sum("n"), digits).alias("text_ratio"),
    )


__all__ = ["PRESETS", "clean_corpus", "clean_text", "coverage_by_step", "vocab_by_step", "build_vocab"]
