"""Deterministic samples: by hash order, stride, quota and fold.  None uses a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def capped(df: DataFrame, *, strata: list[str], key: Column, cap: int, exempt: Column | None = None) -> DataFrame:
    """At most ``cap`` rows of each stratum, of smallest key; ``exempt`` rows stay and use no place."""
    free = F.lit(False) if exempt is None else exempt
    ranked = df.withColumn("__free", free).withColumn("__key", key)
    order = W.partitionBy(*strata, "__free").orderBy("__key")
    return ranked.withColumn("__rank", F.row_number().over(order)).filter(F.col("__free") | (F.col("__rank") <= cap)).drop("__free", "__key", "__rank")


def weighted_top(df: DataFrame, *, by: list[str], key: Column, n: int) -> DataFrame:
    """The ``n`` rows of smallest key in each group, with ``inclusion`` chance and ``weight`` its inverse."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(key))).withColumn("__all", F.count("*").over(W.partitionBy(*by)))
    taken = F.least(F.lit(n), F.col("__all"))
    return ranked.filter(F.col("__rank") <= n).withColumns({"inclusion": taken / F.col("__all"), "weight": F.col("__all") / taken}).drop("__rank", "__all")


def stride(df: DataFrame, *, by: list[str], order: list[str], k: int) -> DataFrame:
    """The rows at ``floor(i n / k)`` for i below k, of each group in order; all rows if there are at most k."""
    ranked = df.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*by)))
    # row r is taken if some i has floor(i n / k) = r: the first i with i n / k >= r must give r
    i = F.ceil(F.col("__i") * k / F.col("__n"))
    taken = (i < k) & (F.floor(i * F.col("__n") / F.lit(k)) == F.col("__i"))
    return ranked.filter((F.col("__n") <= k) | taken).drop("__i", "__n")


def supplemented(df: DataFrame, *, by: str, key: str, per_group: int, total: int) -> DataFrame:
    """The first ``per_group`` rows of each group by key, filled up to ``total`` with the next rows of all groups.

    The fill looks at the ``total`` smallest remaining keys only, so no window
    runs over all rows.
    """
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(by).orderBy(key)))
    first = ranked.filter(F.col("__rank") <= per_group).withColumn("picked", F.lit("group"))
    rest = ranked.filter(F.col("__rank") > per_group).orderBy(key).limit(total).withColumn("picked", F.lit("fill"))
    room = first.agg(F.greatest(F.lit(0), total - F.count("*")).alias("__room"))
    fill = rest.withColumn("__place", F.row_number().over(W.orderBy(key))).join(F.broadcast(room)).filter(F.col("__place") <= F.col("__room"))
    return first.drop("__rank").unionByName(fill.drop("__rank", "__place", "__room"))


def one_per_unit(df: DataFrame, *, unit: str, label: str, first: str, key: str, per_class: int) -> DataFrame:
    """``per_class`` rows of each class by key, each unit once over all classes, class ``first`` served first."""
    priority = F.when(F.col(label) == first, 0).otherwise(1)
    once = df.withColumn("__u", F.row_number().over(W.partitionBy(unit).orderBy(priority, key))).filter("__u = 1").drop("__u")
    return once.withColumn("__c", F.row_number().over(W.partitionBy(label).orderBy(key))).filter(F.col("__c") <= per_class).drop("__c")


def audit_size(n: Column, percent: int = 10, least: int = 1, most: int = 3) -> Column:
    """``ceil(percent of n)``, at least ``least``, at most ``most`` and ``n``."""
    return F.least(n, F.lit(most), F.greatest(F.lit(least), F.ceil(n * percent / 100).cast("int"))).cast("int")


def alternate_split(groups: DataFrame, *, stratum: str, group: str) -> DataFrame:
    """``side`` 0 or 1: the sorted distinct groups of each stratum in turn."""
    distinct = groups.select(stratum, group).distinct()
    return distinct.withColumn("side", (F.row_number().over(W.partitionBy(stratum).orderBy(group)) - 1) % 2)


def sorted_folds(df: DataFrame, *, group: str, k: int) -> DataFrame:
    """``(group, fold)``: the place of each distinct group in sorted order, modulo ``k``.

    The window runs over one row a group.
    """
    return df.select(group).distinct().withColumn("fold", (F.row_number().over(W.orderBy(group)) - 1) % k)
