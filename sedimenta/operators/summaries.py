"""Populations, thresholds, valid-time joins and other summaries of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def populations(df: DataFrame, *, agent: Column, date: str, modern: str = "2024-01-01", old: str = "2023-01-01") -> DataFrame:
    """Adds ``population``: signed or unsigned from ``modern`` on, pre before ``old``; rows between are in none."""
    late, early = F.col(date) >= modern, (F.col(date) < old) & (F.col(date) != "")
    return df.withColumn("population", F.when(agent & late, "signed").when(~agent & late, "unsigned").when(early, "pre"))


def threshold_sweep(df: DataFrame, *, by: list[str], score: str, amount: str, thresholds: list[float]) -> DataFrame:
    """Rows and amount at or above each threshold, with their shares; null where there is nothing."""
    grid = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.col(score) >= F.col("threshold")
    out = grid.groupBy(*by, "threshold").agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.sum(amount).alias("amount"), F.sum(F.when(hit, F.col(amount)).otherwise(0)).alias("hit_amount"))
    return out.withColumn("row_share", F.try_divide("hits", "rows")).withColumn("amount_share", F.try_divide("hit_amount", "amount"))


def before_after(df: DataFrame, *, by: list[str], at: str, turn: str, hit: Column) -> DataFrame:
    """Share of hits before and from the turning point of each group, and the change; null where a side is empty."""
    late = F.col(at) >= F.col(turn)
    pre, post = F.try_divide(F.count_if(~late & hit), F.count_if(~late)), F.try_divide(F.count_if(late & hit), F.count_if(late))
    return df.groupBy(*by).agg(pre.alias("before"), post.alias("after"), (post - pre).alias("change"))


def valid_labels(df: DataFrame, labels: DataFrame, *, key: str, at: str, start: str, end: str, label: str, none: str) -> DataFrame:
    """Adds the label that is valid for the key at the row's time, else ``none``; of several the smallest."""
    # repeated rows are joined once and come back as often as they stood
    rows = df.groupBy(F.struct(*df.columns).alias("__row")).agg(F.count("*").alias("__copies")).select("__row", "__copies", "__row.*")
    spans = labels.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(label).alias("__l"))
    joined = rows.join(spans, (F.col(key) == F.col("__k")) & F.col(at).between(F.col("__s"), F.col("__e")), "left")
    out = joined.groupBy("__row").agg(F.coalesce(F.min("__l"), F.lit(none)).alias(label), F.first("__copies").alias("__copies"))
    return out.select("__row.*", label, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__i")).drop("__i")


def first_quotes(df: DataFrame, *, by: str, order: str, text: str, pattern: str, most: int = 3, longest: int = 240) -> DataFrame:
    """The first ``most`` matches of a pattern over the texts of a group in order, cut to ``longest`` characters."""
    hits = df.select(by, order, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("i", "quote"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order, "i")))
    return ranked.filter(F.col("rank") <= most).select(by, "rank", F.substring("quote", 1, longest).alias("quote"))


def exclusion_counts(df: DataFrame, *, by: list[str], reason: Column) -> DataFrame:
    """Rows by first failing reason, ``kept`` for those that pass."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def complete_panel(df: DataFrame, *, unit: str, period: str, feature: str, value: str, features: list[str]) -> DataFrame:
    """Wide rows of each unit's first and last period that have every feature."""
    wide = df.groupBy(unit, period).pivot(feature, features).agg(F.first(value)).dropna(subset=features)
    run = W.partitionBy(unit)
    return wide.withColumn("__lo", F.min(period).over(run)).withColumn("__hi", F.max(period).over(run)).filter((F.col(period) == F.col("__lo")) | (F.col(period) == F.col("__hi"))).drop("__lo", "__hi")


def final_decisions(reviews: DataFrame, *, case: str, stage: str, decision: str) -> DataFrame:
    """Two equal primary reviews decide; else the resolution does."""
    pick = lambda s: F.max(F.when(F.col(stage) == s, F.col(decision)))
    wide = reviews.groupBy(case).agg(pick("primary").alias("p"), pick("secondary").alias("s"), pick("resolution").alias("r"))
    agreed = F.col("p") == F.col("s")
    return wide.select(case, F.when(agreed, F.col("p")).otherwise(F.col("r")).alias("decision"), F.when(agreed, "primary_agreement").when(F.col("r").isNotNull(), "resolution").otherwise("pending").alias("basis"))


def citations(df: DataFrame, names: DataFrame, *, citing: str, cited: str, name: str, canonical: str) -> DataFrame:
    """Distinct citations of another unit: listed names mapped to canonical ids, own ones left out; all units stay with a count."""
    each = df.select(citing, F.explode(cited).alias(name)).join(names.select(name, canonical), name).filter(F.col(canonical) != F.col(citing)).select(citing, canonical).distinct()
    return df.select(citing).distinct().join(each.groupBy(citing).agg(F.count("*").alias("n"), F.min(canonical).alias("first")), citing, "left").select(citing, F.coalesce("n", F.lit(0)).alias("n"), "first")


def paired_difference(left: DataFrame, right: DataFrame, *, key: str, good: str, seen: str) -> DataFrame:
    """Difference of survival over equal id sets: the mean of the pairs' own, and pooled."""
    a = left.select(key, F.col(good).alias("ga"), F.col(seen).alias("sa"))
    b = right.select(key, F.col(good).alias("gb"), F.col(seen).alias("sb"))
    both = a.join(b, key).filter("sa > 0 and sb > 0")
    return both.agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("ga") / F.col("sa") - F.col("gb") / F.col("sb")).alias("balanced"),
        (F.sum("ga") / F.sum("sa") - F.sum("gb") / F.sum("sb")).alias("pooled"),
    )
