"""Quarters, overlapping partitions and instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quarter_index(at: Column) -> Column:
    """Calendar quarters since year 0: ``year * 4 + quarter - 1``."""
    return F.year(at) * 4 + F.quarter(at) - 1


def quarter_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 4).cast("int"), (index % 4 * 3 + 1).cast("int"), F.lit(1))


def quarter_end(index: Column) -> Column:
    """Last day of the quarter."""
    return F.date_sub(quarter_start(index + 1), 1)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``; null where negative."""
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)
    return F.when(days >= 0, days)


def overlapping_intervals(spark: SparkSession, start: str, end: str, *, days: int = 14, overlap: int = 1) -> DataFrame:
    """``(position, lo, hi)``: windows of ``days`` over [start, end), widened by ``overlap`` days but at the outer edges."""
    edges = spark.range(1).select(F.posexplode(F.expr(f"sequence(date'{start}', date_sub(date'{end}', 1), interval {days} days)")).alias("position", "at"))
    lo = F.when(F.col("position") == 0, F.col("at")).otherwise(F.date_sub("at", overlap))
    hi = F.least(F.date_add(F.date_add("at", days), overlap), F.lit(end).cast("date"))
    return edges.select("position", lo.alias("lo"), hi.alias("hi"))
