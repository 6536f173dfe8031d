"""Total orders without a window over all rows: ranges of rows, numbered by what stands before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators.quantify import same_keys
from sedimenta.plans.scratch import materialize


def ranged(df: DataFrame, order: list[Column], *, name: str) -> DataFrame:
    """``df`` with the number of the range that each row falls in; ranges follow each other in ``order``, equal keys share one.

    The table is written, so that the ranges stay what they are.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def numbered(df: DataFrame, *, order: list[str], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Adds the row's number in ``order``, from 0, within ``by``; rows equal in all of ``order`` stand in any order.

    A ``by`` of very many rows spreads over ranges; only counts of ranges are added up in order.
    """
    by = by or []
    cut = ranged(df, [F.col(c) for c in [*by, *order]], name="__range")
    counts = cut.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*by, "__range").orderBy(*order)
    placed = cut.withColumn("__at", F.row_number().over(inside) - 1)
    return same_keys(placed, base, [*by, "__range"]).withColumn(name, F.col("__base") + F.col("__at")).drop("__range", "__base", "__at")


def order_violations(df: DataFrame, *, sequence: str, keys: list[str]) -> DataFrame:
    """Rows whose ``keys``, taken together, are not above those of the row before in ``sequence``; ``same`` where they are equal.

    Nulls come first in the order of keys.  Rows are compared inside ranges of the
    sequence, and the first row of each range with the last one of the range before.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    cut = ranged(df.select(sequence, *keys), [F.col(sequence)], name="__range").withColumn("__key", key)
    inside = W.partitionBy("__range").orderBy(sequence)
    ends = cut.groupBy("__range").agg(F.max_by("__key", sequence).alias("__last"))
    border = ends.select("__range", F.lag("__last").over(W.orderBy("__range")).alias("__before"))  # a row a range
    seen = cut.withColumn("__own", F.lag("__key").over(inside)).join(border, "__range").withColumn("__prior", F.coalesce("__own", "__before"))
    wrong = F.col("__prior").isNotNull() & ~(F.col("__key") > F.col("__prior"))
    return seen.filter(wrong).select(sequence, *keys, (F.col("__key") == F.col("__prior")).alias("same"))


def stratified_draws(units: DataFrame, *, unit: str, strata: list[str], replicates: int, seed: str, folds: int = 1) -> DataFrame:
    """``(replicate, strata, unit, fold, copies)``: resamples of each stratum with as many draws as it has units.

    Draw ``j`` of a stratum takes the unit whose place in sorted order is the head of
    ``sha256(seed NUL strata NUL replicate NUL j)`` modulo their number, and falls in fold ``j`` modulo ``folds``.
    """
    placed = numbered(units.select(*strata, unit).distinct(), order=[unit], by=strata, name="place")
    sizes = placed.groupBy(*strata).agg(F.count("*").alias("n"))
    # few small rows become many draws: a shuffle of a fixed number of tasks is not merged into one, as AQE would by size
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism)
    draws = same_keys(placed.select(*strata, F.col("place").alias("j")), sizes, strata).repartition(tasks, *strata, "j").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    parts = [F.lit(seed), *[F.coalesce(F.col(s).cast("string"), F.lit("null")) for s in strata], F.col("replicate").cast("string"), F.col("j").cast("string")]
    digest = F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)
    drawn = draws.select(*strata, "replicate", (F.col("j") % folds).cast("int").alias("fold"), (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")).alias("place"))
    counted = drawn.groupBy(*strata, "replicate", "fold", "place").agg(F.count("*").alias("copies"))
    return same_keys(counted, placed, [*strata, "place"]).select("replicate", *strata, unit, "fold", "copies")
