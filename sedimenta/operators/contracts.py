"""Contracts as data: rows or groups that break a rule, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(df: DataFrame, *, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``(key, errors)`` of rows that break a rule; a rule that is null counts as broken."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, errors.alias("errors")).filter(F.size("errors") > 0)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand on more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, *, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias("__parent")), F.col(child_key) == F.col("__parent"), "left_anti")


def rises(df: DataFrame, *, by: list[str], order: str, value: str, slack: float = 1e-12) -> DataFrame:
    """Rows at which a value that should never rise is above the one before."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return df.withColumn("before", before).filter(F.col(value) > F.col("before") + slack)


def mass_errors(df: DataFrame, *, parts: list[str], slack: float = 1e-9) -> DataFrame:
    """Rows whose parts do not add up to 1."""
    return df.filter(F.abs(reduce(lambda a, b: a + b, [F.col(p) for p in parts]) - 1) > slack)
