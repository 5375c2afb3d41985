"""Session helpers.

Library code never creates a session; it receives one. ``local_session`` is
for tests, the bench and the examples.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "textflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session configured the way the cluster one should be:
    AQE on (coalescing, skew join), Arrow on, UI off."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("TEXTFLOW_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the
    session. Where that is unset a local session (tests, bench) gets a
    temporary folder; a cluster session is refused, since its executors
    would not share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textflow-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") + "/textflow"


def lineage_cut(df: DataFrame) -> DataFrame:
    """Write a table that feeds many jobs (model fits, sweeps, iterations) to
    the shared folder as Parquet and read it back: the lineage ends there,
    scans stay pruned and pushed down, and the loss of an executor costs no
    more than a reread. ``release`` deletes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def no_nulls(df: DataFrame) -> DataFrame:
    """Empty lists and bytes in place of nulls, for tables that go to Python: Spark measures a batch row by
    row, and Arrow fills up the nulls since the last list anew each time, with the square of the rows."""
    empty = {"array": lambda kind: F.array().cast(kind), "binary": lambda kind: F.lit(b"")}
    return df.withColumns({f.name: F.coalesce(f.name, empty[f.dataType.typeName()](f.dataType)) for f in df.schema if f.dataType.typeName() in empty})


def release(df: DataFrame) -> None:
    """Delete a table that ``lineage_cut`` wrote and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = sc._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so for what the driver has collected as garbage, which
    with a small plan may be never, while the files grow with the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
