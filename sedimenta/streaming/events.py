"""Event-time windows, sessions and deduplication; each takes a batch or a streaming frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.scratch import scratch_dir


def windowed(events: DataFrame, *, at: str, keys: list[str], size: str, late: str, value: str) -> DataFrame:
    """``start, keys, n, total`` by tumbling window; a stream drops rows later than ``late``."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, *, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """``start, end, keys, n``: runs of events of a key with gaps below ``gap``."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, *, at: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key inside the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all that is there, writes it in the scratch folder and reads it back."""
    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
