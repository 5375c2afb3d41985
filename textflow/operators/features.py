"""Feature operators: tokens, stop words, term counts, TF-IDF, word vectors.

Counts are relational: ``term_count_rows``, ``idf_rows``, ``tf_idf_rows`` and
``counted_words`` are group-bys and joins over exploded tokens, without a
vocabulary limit and without a table on the driver. The vectors that models
read are assembled in ``term_index``, by joins as well.
"""

from __future__ import annotations

from pyspark.ml.feature import IDF, IDFModel, StopWordsRemover, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import struct_entries, vector_struct
from ..session import lineage_cut, release

# Partitions that word vectors are trained on at least, unless given.
W2V_PARTITIONS = 8


def tokenize(df: DataFrame, input_col: str = "question_text", output_col: str = "words") -> DataFrame:
    """Lower-case, then split on each whitespace character. Empty tokens
    between two whitespace characters stay; trailing ones go."""
    return Tokenizer(inputCol=input_col, outputCol=output_col).transform(df)


def remove_stop_words(df: DataFrame, input_col: str = "words", output_col: str = "filtered",
                      stop_words: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Remove English stop words (Spark's default list unless given)."""
    r = StopWordsRemover(inputCol=input_col, outputCol=output_col, caseSensitive=case_sensitive)
    if stop_words is not None:
        r = r.setStopWords(list(stop_words))
    return r.transform(df)


# --- relational long forms ---


def term_count_rows(tokens: DataFrame, id_col: str, col: str = "filtered") -> DataFrame:
    """``(id, term, tf bigint)``: occurrences of each term in each document. The tokens are written once:
    Spark's filter for empty lists would repeat the tokenising, and whatever else made them."""
    return _term_counts(lineage_cut(tokens.select(id_col, col)), id_col, col)


def _term_counts(tokens: DataFrame, id_col: str, col: str) -> DataFrame:
    return (tokens.select(id_col, F.explode(col).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_freq_rows(tokens: DataFrame, col: str = "filtered") -> DataFrame:
    """``(term, doc_freq bigint)``: documents that hold each term."""
    return tokens.select(F.explode(F.array_distinct(col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def idf_rows(tokens: DataFrame, col: str = "filtered", min_df: int = 1) -> DataFrame:
    """``(term, doc_freq bigint, idf double)`` with ``idf = ln((m + 1) /
    (doc_freq + 1))`` over ``m`` documents (one count reaches the driver)."""
    m = tokens.count()
    return doc_freq_rows(tokens, col).where(F.col("doc_freq") >= min_df).withColumn("idf", F.log((F.lit(m) + 1.0) / (F.col("doc_freq") + 1.0)))


def tf_idf_rows(tokens: DataFrame, id_col: str, col: str = "filtered", min_df: int = 1) -> DataFrame:
    """``(id, term, tfidf double)``: term counts times IDF, joined on the term.
    The tokens are written once, as three jobs read them."""
    tokens = lineage_cut(tokens.select(id_col, col))
    counts = _term_counts(tokens, id_col, col)
    idf = idf_rows(tokens, col, min_df)
    return counts.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("tfidf"))


def counted_words(tokens: DataFrame, col: str = "filtered", min_count: int = 2) -> DataFrame:
    """``(word, n)`` of the words with ``min_count`` occurrences at least: those
    that get a word vector."""
    return (tokens.select(F.explode(col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# --- model input ---


def fit_idf(df: DataFrame, input_col: str = "rawFeatures", output_col: str = "features",
            min_doc_freq: int = 0) -> IDFModel:
    """IDF = ln((m + 1) / (df + 1)) over ``m`` documents."""
    return IDF(inputCol=input_col, outputCol=output_col, minDocFreq=min_doc_freq).fit(df)


def tf_idf(df: DataFrame, input_col: str = "rawFeatures", output_col: str = "features",
           min_doc_freq: int = 0) -> tuple[IDFModel, DataFrame]:
    model = fit_idf(df, input_col, output_col, min_doc_freq)
    return model, model.transform(df)


def vector_long_form(df: DataFrame, vector_col: str, id_col: str, vocab: DataFrame,
                     value_name: str = "value") -> DataFrame:
    """``(id, term, value)`` for every stored entry of a sparse vector."""
    s = df.select(F.col(id_col), vector_struct(vector_col).alias("_v"))
    e = s.select(F.col(id_col), F.explode(struct_entries("_v")).alias("e"))
    e = e.select(id_col, F.col("e.index").alias("index"), F.col("e.value").alias(value_name))
    return e.join(vocab, "index").select(id_col, "term", value_name)


class WordVectors:
    """Fitted word vectors: ``table`` has ``(term, n, vector array<float>)``, and no task or driver holds it whole."""

    def __init__(self, table: DataFrame, input_col: str, output_col: str, size: int, blocks: int):
        self.table, self.input_col, self.output_col, self.size, self.blocks = table, input_col, output_col, size, blocks

    def getVectors(self) -> DataFrame:  # noqa: N802 (the name that Spark's model has)
        """``(word, vector)``."""
        return self.table.select(F.col("term").alias("word"), array_to_vector("vector").alias("vector"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean of each document's word vectors; unknown words count as zeros."""
        from .word_tables import block_means

        return block_means(df, self.input_col, self.table, self.output_col, self.size, self.blocks)


def word_vectors(df: DataFrame, key: str, input_col: str = "filtered", output_col: str = "wordvectors",
                 size: int = 100, min_count: int = 2, seed: int = 42,
                 partitions: int = W2V_PARTITIONS, max_iter: int = 1,
                 window: int = 5) -> tuple[WordVectors, DataFrame]:
    """Skip-gram word vectors; a document is the mean of its words' vectors.

    Documents are dealt to ``partitions`` at least by a hash of ``key`` and tokens and sorted by it, so
    that a fit repeats exactly and doesn't depend on the number of cores or on the layout of the
    input; each partition trains on its share with the vectors of its own words, and what
    the partitions learned is merged by word (see ``word_tables``).
    """
    from .word_tables import fit_word_tables

    rows = lineage_cut(df)  # read by the fit and the means
    table = fit_word_tables(rows, input_col, size, min_count, window, partitions, max_iter, seed=seed, key=key)
    model = WordVectors(table, input_col, output_col, size, partitions)
    out = model.transform(rows)
    release(rows)
    return model, out


def assemble(df: DataFrame, cols: list[str], output_col: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Concatenate vector / numeric columns into one feature vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=output_col,
                           handleInvalid=handle_invalid).transform(df)
