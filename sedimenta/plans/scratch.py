"""Cutting lineage with tables written in the shared checkpoint folder.

A written table survives the loss of any executor, lets Spark plan the rest of a
job with known sizes, and is columnar, so it is smaller than an RDD checkpoint.
The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset
(local tests) does the library make a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
    return _own[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads; only frames that :func:`materialize` returned."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows that Spark sends to a Python worker at once.

    Documents can be long; the default of 10,000 rows a batch may not fit.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so when the driver has collected the plans that made them, which a
    driver with memory to spare may put off for long.  The plan of the last query
    is held until another one has run, so an empty one runs first.
    """
    spark.range(0).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
