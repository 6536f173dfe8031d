"""Writers: sharded by digest, packed by size, with counts and digests; and resuming from what is there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_shard(digest: Column, shards: int) -> Column:
    """Shard number from the first 8 hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards).cast("int")


def write_shards(df: DataFrame, path: str, *, digest: str, shards: int) -> None:
    """JSON lines by shard, each sorted by digest."""
    out = df.withColumn("shard", digest_shard(F.col(digest), shards))
    out.repartition(shards, "shard").sortWithinPartitions("shard", digest).write.partitionBy("shard").mode("overwrite").json(path)


def manifest(df: DataFrame, *, by: list[str], key: str) -> DataFrame:
    """``rows`` and an order-free digest of the rows of each part: the sum of row hashes."""
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.sum(row).alias("digest"))


def unfinished(plan: DataFrame, done: DataFrame, *, key: str, digest: str) -> DataFrame:
    """Units of the plan without a finished result for the same input digest."""
    return plan.join(done.select(key, digest), [key, digest], "left_anti")


def packed(df: DataFrame, *, by: list[str], order: str, size: Column, most_bytes: int, most_rows: int | None = None) -> DataFrame:
    """Adds ``file``: rows in order fill a file until the next one would exceed ``most_bytes`` or ``most_rows``.

    A row larger than ``most_bytes`` has a file of its own.  The fill is
    sequential, so only ``by``, ``order`` and the size of the rows of a group are
    sent to its task; ``order`` must be unique there.
    """
    narrow = df.select(*by, order, size.cast("long").alias("__size"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__size"], "file long"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        files, file, used, count = [], 0, 0, 0
        for n in rows["__size"]:
            if count and (used + n > most_bytes or count == most_rows):
                file, used, count = file + 1, 0, 0
            files.append(file)
            used, count = used + n, count + 1
        return rows.drop(columns="__size").assign(file=files)

    return df.join(narrow.groupBy(*by).applyInPandas(fill, schema), [*by, order])


def write_filtered(df: DataFrame, path: str, *, keep: Column, key: str) -> DataFrame:
    """Writes the kept rows as JSON lines and returns one row: their number, an order-free digest and how many keys."""
    kept = df.filter(keep)
    kept.write.mode("overwrite").json(path)
    return kept.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"), F.count_distinct(key).alias("keys"))


def write_cases(df: DataFrame, path: str, *, case: str) -> None:
    """JSON lines in one folder a case."""
    df.repartition(case).write.partitionBy(case).mode("overwrite").json(path)


def write_histories(df: DataFrame, path: str, *, line: str, reason: str) -> DataFrame:
    """Writes line histories in order of their ids and returns the rows of each censoring reason."""
    df.orderBy(line).write.mode("overwrite").json(path)
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def verified(rows: DataFrame, manifests: DataFrame, *, by: list[str], key: str) -> DataFrame:
    """Parts whose rows do not match their manifest, or have none, with what differs; empty if all do."""
    found = manifest(rows, by=by, key=key).withColumnsRenamed({"rows": "__rows", "digest": "__digest"})
    both = found.join(manifests.select(*by, "rows", "digest"), by, "full_outer")
    problem = F.when(F.col("rows").isNull(), "no_manifest").when(F.col("__rows").isNull(), "no_rows").when(F.col("rows") != F.col("__rows"), "rows").when(F.col("digest") != F.col("__digest"), "digest")
    return both.withColumn("problem", problem).filter("problem is not null").select(*by, "problem")


def reusable(plan: DataFrame, done: DataFrame, *, key: str, contract: list[str], status: str, retry: list[str]) -> DataFrame:
    """``(key, reuse)`` of every planned unit: a finished result is reused only under an equal contract and a status not to be retried."""
    result = done.select(key, *contract, status).withColumn("__done", F.lit(True))
    found = plan.join(result, [key, *contract], "left")
    return found.select(key, (F.coalesce("__done", F.lit(False)) & ~F.coalesce(F.col(status).isin(*retry), F.lit(False))).alias("reuse"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def write_once(df: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """Writes ``df`` unless a finished copy is there, and reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
