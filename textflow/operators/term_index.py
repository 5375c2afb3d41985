"""Terms as a table with dense numbers, and term vectors assembled by joins.

A vocabulary is ranked by a range-partitioned sort: every partition numbers
its own rows, and the numbers of partitions (one row each) give where a
partition starts. Documents get their sparse vectors by joining term counts to that
table, so no list of terms is held by the driver, by a task or by a model.

Vectors are ``ML`` vectors: the table is written with the layout that a vector
column has in Parquet and read back as one. Rows are told apart by a row
number, so document ids need not be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lineage_cut
from .features import doc_freq_rows

ROW = "__row"
# Numbers of rows within a partition, as monotonically_increasing_id has them.
_PLACE_BITS = 33


@dataclass(frozen=True)
class TermIndex:
    """``table``: ``(term string, index bigint, n bigint, doc_freq bigint)``,
    most frequent first, ties by code point; ``size`` terms; ``documents`` that it was fitted on."""

    table: DataFrame
    size: int
    documents: int


def dense_rank(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """``df`` with the place of every row in ``order`` (0, 1, ...), written to the
    scratch folder. The order should be total, or ties are numbered as they come."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = lineage_cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", _PLACE_BITS), F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()  # a row for each partition
    starts, total = {}, 0
    for r in sizes:
        starts[r.part] = total
        total += r.rows
    first = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    return placed.withColumn(name, (first[part.cast("bigint")] + place).cast("bigint")).drop("__at")


def fit_term_index(df: DataFrame, input_col: str = "filtered", min_df: float = 1.0) -> TermIndex:
    """The terms that occur in ``min_df`` documents at least (a share of the
    documents if below 1). ``df`` is read more than once; give a written table."""
    documents = df.count()
    least = min_df if min_df >= 1 else min_df * documents
    counted = df.select(F.explode(input_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # both sides are partitioned by term already
    counted = counted.join(doc_freq_rows(df, input_col).where(F.col("doc_freq") >= least), "term")
    # written, so that the sort's sample doesn't count anew
    table = dense_rank(lineage_cut(counted), F.col("n").desc(), F.col("term").asc()).select("term", "index", "n", "doc_freq")
    return TermIndex(table, table.count(), documents)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number, written so that the numbers stay."""
    return lineage_cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def term_vectors(rows: DataFrame, index: TermIndex, input_col: str = "filtered", counts: str = "rawFeatures",
                 weights: str | None = "features", min_tf: float = 1.0) -> DataFrame:
    """``rows`` (of ``numbered``) with a sparse vector of term counts and, as
    ``weights``, one of counts times ``ln((m + 1) / (doc_freq + 1))``. Terms that the index lacks,
    and those that occur less than ``min_tf`` times, are left out; a row without terms has empty vectors."""
    tf = rows.select(ROW, F.explode(input_col).alias("term")).groupBy(ROW, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    idf = F.log((F.lit(index.documents) + 1.0) / (F.col("doc_freq") + 1.0))
    entries = (tf.where(F.col("tf") >= min_tf).join(index.table, "term")
               .select(ROW, F.struct(F.col("index").cast("int").alias("i"), F.col("tf"), (F.col("tf") * idf).alias("w")).alias("__e")))
    grouped = entries.groupBy(ROW).agg(F.sort_array(F.collect_list("__e")).alias("__e"))
    vector = lambda of: F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(index.size).cast("int").alias("size"),
                                 F.coalesce(F.col("__e.i"), F.array().cast("array<int>")).alias("indices"),
                                 F.coalesce(F.col(f"__e.{of}"), F.array().cast("array<double>")).alias("values"))
    added = {counts: vector("tf")} | ({weights: vector("w")} if weights else {})
    return as_vectors(rows.drop(counts, *([weights] if weights else [])).join(grouped, ROW, "left").withColumns(added).drop("__e"), *added)


def as_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """Structs of a vector's layout (type, size, indices, values) as vectors."""
    written = lineage_cut(df)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name in columns else f.dataType) for f in df.schema])
    return df.sparkSession.read.schema(schema).parquet(*_folder(written))


def _folder(df: DataFrame) -> list[str]:
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def vector_rows(df: DataFrame, index: TermIndex, key: str, vector: str, name: str = "value") -> DataFrame:
    """``(key, term, value)`` of every stored entry of ``vector``."""
    from ..functions.arrays import struct_entries, vector_struct

    entries = df.select(key, vector_struct(vector).alias("v")).select(key, F.explode(struct_entries("v")).alias("e"))
    return (entries.select(key, F.col("e.index").cast("bigint").alias("index"), F.col("e.value").alias(name))
            .join(index.table.select("term", "index"), "index").select(key, "term", name))
