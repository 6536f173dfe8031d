"""The event table as a stream, and the same windows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.queries import query, table
from sedimenta.streaming import events as E


@query(
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows of the stream that the watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream reads folders and patterns
    out = E.run_once(E.windowed(stream, at="ts", keys=["event_type"], size="6 hours", late="1 hour", value="value"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.sessions(table(spark, sf_dir, "events"), at="ts", keys=["user_id"], gap="8 hours", late="1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY ALL")
def stream_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream keeps of repeated events of one user, type and day."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("day", F.to_date("ts").cast("string"))
    return E.run_once(E.deduplicated(stream, at="ts", keys=["user_id", "event_type", "day"], late="1 hour")).select("user_id", "event_type", "day")
