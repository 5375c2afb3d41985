"""Readers and writers for the labelled corpus, lexicons and feature tables.

Schemas are declared, never inferred: inference costs an extra pass over
the input and can change type with the data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words_of
from ..session import lineage_cut
from .word2vec import register

CORPUS = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("question_text", T.StringType()),
    T.StructField("target", T.IntegerType()),
])

FEATURES_TEXT = T.StructType([
    T.StructField("target", T.IntegerType()),
    T.StructField("topics", T.StringType()),
])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS,
                fmt: str = "csv", **options) -> DataFrame:
    """Read a labelled corpus (``qid, question_text, target``), columns picked
    by name.

    CSV needs a header; its columns may come in any order and more of them
    are dropped. Lines are records, so that a file splits into tasks; pass
    ``multiLine=True`` for quoted fields that hold newlines (one task per
    file then). A value that isn't of its column's type is NULL.
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').options(**options)
        df = reader.csv(path)
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_checked(spark: SparkSession, path: str, schema: T.StructType = CORPUS, columns: list[str] | None = None,
                 **options) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV corpus that parse, and those that don't:
    ``(schema..., )`` and ``(file, record, reason)``. A record is rejected if it hasn't as many
    fields as there are columns (reason ``columns``), or holds a value, other than an empty one, that isn't
    of its column's type (reason ``type of <column>``, the first of them). ``columns`` names the fields
    of files without a head line. The parsed lines are written once, so that both results come from one read."""
    reader = spark.read.option("inferSchema", False).option("escape", '"').options(**options)
    names = columns or reader.option("header", True).csv(path).columns
    corrupt = "__record"
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, corrupt]])
    rows = (reader.option("header", columns is None).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
            .schema(text).csv(path).select("*", F.col("_metadata.file_path").alias("__file")))
    wrong = F.when(F.col(corrupt).isNotNull(), "columns")
    for f in schema.fields:
        wrong = wrong.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f"type of {f.name}")
    checked = lineage_cut(rows.withColumn("__reason", wrong))
    good = checked.where(F.col("__reason").isNull()).select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    record = F.coalesce(F.col(corrupt), F.to_csv(F.struct(*names)))
    bad = checked.where(F.col("__reason").isNotNull()).select(F.col("__file").alias("file"), record.alias("record"), F.col("__reason").alias("reason"))
    return good, bad


def rename_positional(df: DataFrame, *names: str) -> DataFrame:
    """Rename every column by position (``toDF``)."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def as_labelled(df: DataFrame, label: str = "target", features: str = "topics") -> DataFrame:
    """Select the class and feature columns as ``label, features``."""
    return df.selectExpr(f"`{label}` AS label", f"`{features}` AS features")


def read_features(spark: SparkSession, path: str, vector_col: str = "topics",
                  label_col: str = "target", fmt: str = "csv") -> DataFrame:
    """Read an exported feature table by path or glob.

    CSV keeps vectors as text (parse them with ``parse_vector``); Parquet
    keeps real arrays. Any format name Spark knows is accepted, including
    the old external CSV name ``com.databricks.spark.csv``, which Spark
    maps to its built-in CSV source. Extra columns (such as an unnamed
    index written by a pandas export) are dropped by the projection.
    """
    if fmt in ("csv", "com.databricks.spark.csv"):
        df = spark.read.format(fmt).option("header", True).option("inferSchema", False).load(path)
        return df.select(F.col(label_col).cast("int").alias(label_col), F.col(vector_col))
    return spark.read.format(fmt).load(path).select(label_col, vector_col)


def read_lexicon(spark: SparkSession, path: str, fmt: str = "parquet",
                 word_col: str = "word", vectors: bool = True) -> DataFrame:
    """Read a lexicon of known words: ``word`` and, with ``vectors`` and where
    there is one, its ``vector``; one row per word. Of a repeated word the
    smallest vector is kept (arrays compared item by item). Text files hold one ``word v1 v2 ...``
    per line; a head line of two numbers (``count width``) is skipped, and a
    value that is no number is NULL. ``word2vec`` is the binary format (``sources.word2vec``). For membership alone pass
    ``vectors=False``, so that only words are shuffled."""
    if fmt == "word2vec":
        register(spark)
    if fmt == "text":
        lines = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+\s*$"))
        p = F.split(F.col("value"), " ", 2)
        df = lines.select(F.get(p, 0).alias("word"), F.transform(
            F.split(F.trim(F.get(p, 1)), " "), lambda x: x.try_cast("float")).alias("vector"))
    else:
        df = spark.read.format(fmt).load(path).withColumnRenamed(word_col, "word")
    if not vectors or "vector" not in df.columns:
        return df.select("word").distinct()
    return df.groupBy("word").agg(F.min("vector").alias("vector"))


def lexicon_from_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Known words taken as the distinct whitespace words of a text column."""
    return df.select(F.explode(words_of(col)).alias("word")).distinct()


def write_features(df: DataFrame, path: str, fmt: str = "parquet",
                   text_vectors: bool = False, mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """Distributed export of a feature table (every task writes its part).

    ``text_vectors=True`` writes arrays as ``[a, b, ...]`` text, the layout
    older readers expect; vectors are turned into arrays first.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.ml.functions import vector_to_array
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, VectorUDT):
            c = vector_to_array(c)
            dt = T.ArrayType(T.DoubleType())
        else:
            dt = f.dataType
        if text_vectors and isinstance(dt, T.ArrayType):
            c = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
        cols.append(c.alias(f.name))
    w = df.select(cols).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# --- exports that are read whole or not at all ---


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def export_features(df: DataFrame, path: str, fmt: str = "parquet", text_vectors: bool = False) -> int:
    """Write a feature table under ``path`` as a further version: the table to a folder of its own,
    then a manifest (format, folder, columns, files and their sizes) that takes its name in one step. Readers see
    the last version whose manifest is there, so an export that failed or is being
    retried is never half read. Returns the version; older ones stay."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    write_features(df, f"{path}/{folder}", fmt, text_vectors, mode="errorifexists")
    system, at = _system(spark, path)
    files = [[f.getPath().getName(), f.getLen()] for f in system.listStatus(at(f"{path}/{folder}")) if not f.getPath().getName().startswith(("_", "."))]
    body = json.dumps({"format": fmt, "folder": folder, "columns": df.columns, "files": files}).encode()
    draft = at(f"{path}/.manifest-{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(bytearray(body))
    out.close()
    version = max([v for v, _ in _manifests(spark, path)], default=0) + 1
    while not system.rename(draft, at(f"{path}/manifest-{version:09d}.json")):  # taken by another export
        version += 1
    return version


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    system, at = _system(spark, path)
    if not system.exists(at(path)):
        return []
    names = [f.getPath().getName() for f in system.listStatus(at(path))]
    return sorted((int(n[9:-5]), f"{path}/{n}") for n in names if n.startswith("manifest-"))


def read_export(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of an export (or the given one), by the files of its manifest; a file that
    is missing or of another size is an error. CSV columns come as text."""
    found = dict(_manifests(spark, path))
    if not found:
        raise FileNotFoundError(f"no finished export under {path}")
    manifest = json.loads("".join(r.value for r in spark.read.text(found[version or max(found)]).collect()))
    system, at = _system(spark, path)
    folder = f"{path}/{manifest['folder']}"
    held = {f.getPath().getName(): f.getLen() for f in system.listStatus(at(folder))}
    wrong = [n for n, size in manifest["files"] if held.get(n) != size]
    if wrong:
        raise ValueError(f"files of {folder} are missing or changed: {wrong[:5]}")
    reader = spark.read.format(manifest["format"])
    if manifest["format"] == "csv":
        reader = reader.option("header", True)
    return reader.load([f"{folder}/{n}" for n, _ in manifest["files"]]).select(*manifest["columns"])
