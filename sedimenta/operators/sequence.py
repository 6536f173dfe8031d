"""Operators on rows in order: gaps, bursts, islands, tilings and stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(df: DataFrame, *, by: list[str], order: list[str], at: Column, name: str) -> DataFrame:
    """Seconds since the previous row of the same ``by``; null for the first."""
    seconds = F.unix_micros(at.cast("timestamp")) / F.lit(1e6)
    return df.withColumn(name, seconds - F.lag(seconds).over(W.partitionBy(*by).orderBy(*order)))


def trailing_count(df: DataFrame, *, by: list[str], order: list[str], at: Column, seconds: int, name: str) -> DataFrame:
    """Rows of the same ``by`` that come earlier in ``order`` and at most ``seconds`` before.

    The lower edge counts; of rows at the same instant those earlier in the
    order count.  A range frame gives all rows up to the same instant; the row
    itself and the later ones of its instant are taken off.
    """
    micros = F.unix_micros(at.cast("timestamp"))
    frame = W.partitionBy(*by).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    instant = W.partitionBy(*by, micros)
    later = F.count("*").over(instant) - F.row_number().over(instant.orderBy(*order))
    return df.withColumn(name, F.count("*").over(frame) - 1 - later)


def islands(df: DataFrame, *, by: list[str], position: str, same: list[str]) -> DataFrame:
    """Maximal runs of consecutive ``position`` with equal ``same``: one row a run, with ``first``, ``last``, ``rows``."""
    order = W.partitionBy(*by).orderBy(position)
    joined = F.lag(position).over(order) == F.col(position) - 1
    for c in same:
        joined = joined & F.lag(c).over(order).eqNullSafe(F.col(c))
    runs = df.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(order))
    return runs.groupBy(*by, "run", *same).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("rows"))


def tiles(df: DataFrame, *, by: list[str], start: str, end: str, first: int | Column = 1, last: Column | None = None) -> DataFrame:
    """``(by, tiled)``: whether the half-open intervals of each group, in order, cover ``first`` to ``last`` exactly."""
    order = W.partitionBy(*by).orderBy(start, end)
    first_value = first if isinstance(first, Column) else F.lit(first)
    fits = F.coalesce(F.lag(end).over(order) == F.col(start), F.col(start) == first_value) & (F.col(end) > F.col(start))
    checked = df.withColumn("__fits", fits)
    whole = F.bool_and("__fits") if last is None else F.bool_and("__fits") & (F.max(end) == F.max(last))
    return checked.groupBy(*by).agg(whole.alias("tiled"))


def stop_rule(df: DataFrame, *, by: list[str], position: str, decision: str, accept: str, skip: list[str]) -> DataFrame:
    """Folds decisions in order: skip some, stop at the first ``accept``, else the first unresolved is active.

    Returns ``eligible`` (rows up to the stop), ``completed`` (of these the
    decided ones), ``active`` (its position) and ``state``.
    """
    accepted = F.min(F.when(F.col(decision) == accept, F.col(position)))
    pending = F.min(F.when(F.col(decision).isNull() | ~F.col(decision).isin(accept, *skip), F.col(position)))
    marks = df.groupBy(*by).agg(accepted.alias("accepted"), pending.alias("pending"), F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(decision).isNotNull().alias("d")))).alias("all"))
    stop = F.least(F.col("accepted"), F.col("pending"))
    upto = F.filter("all", lambda x: stop.isNull() | (x["p"] <= stop))
    state = F.when(F.col("accepted").isNotNull() & (F.col("pending").isNull() | (F.col("accepted") < F.col("pending"))), "accepted").when(F.col("pending").isNotNull(), "active").otherwise("exhausted")
    return marks.select(
        *by,
        F.size(upto).alias("eligible"),
        F.size(F.filter(upto, lambda x: x["d"])).alias("completed"),
        F.when(state == "active", F.col("pending")).alias("active"),
        state.alias("state"),
    )


def until_quota(df: DataFrame, *, by: list[str], order: list[Column], stratum: str, quotas: dict[str, int]) -> DataFrame:
    """Rows of each group in order, up to the first at which every stratum's quota is met."""
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = F.lit(True)
    for s, n in quotas.items():
        met = met & (F.sum((F.col(stratum) == s).cast("int")).over(run) >= n)
    marked = df.withColumn("__met", met.cast("int"))
    before = F.coalesce(F.max("__met").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__before", before).filter("__before = 0").drop("__met", "__before")


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], target: str, time: str, position: str, least: str, value: str) -> DataFrame:
    """For each left row the ``value`` of the right row of highest ``position`` with ``time <= target`` and ``position >= least``.

    Left rows without one stay, with null.
    """
    # repeated left rows are joined once and come back as often as they stood
    rows = left.groupBy(F.struct(*left.columns).alias("__row")).agg(F.count("*").alias("__copies")).select("__row", "__copies", "__row.*")
    hit = (F.col(f"r.{time}") <= F.col(f"l.{target}")) & (F.col(f"r.{position}") >= F.col(f"l.{least}"))
    for c in by:
        hit = hit & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    joined = rows.alias("l").join(right.alias("r"), hit, "left")
    best = joined.groupBy("l.__row").agg(F.first("l.__copies").alias("__copies"), F.max_by(F.col(f"r.{value}"), F.struct(F.col(f"r.{position}"), F.col(f"r.{time}"))).alias("found"))
    return best.select("__row.*", "found", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__i")).drop("__i")
