"""What the two vector searches share: which rows take part, and merging of found lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vec: Column, *, zero: bool) -> Column:
    """True for a non-empty vector of finite components; all-zero ones only if ``zero``."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.lit(True) if zero else F.exists(vec, lambda x: x != 0)
    return F.coalesce((F.size(vec) > 0) & finite & some, F.lit(False))


def best(found: DataFrame, k: int, *, descending: bool) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query, each vector once, ties to the smaller id.

    ``found`` holds short lists from many tasks, so the windows see a bounded
    number of rows a query.
    """
    once = found.groupBy("query_id", "vec_id").agg((F.max if descending else F.min)("score").alias("score"))
    order = F.col("score").desc() if descending else F.col("score").asc()
    run = W.partitionBy("query_id").orderBy(order, F.col("vec_id").asc())
    return once.withColumn("rank", F.row_number().over(run)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
