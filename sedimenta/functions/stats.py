"""Aggregates with fixed rules for empty and degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: ``sum(v w) / sum(w)``; null where the weights sum to 0."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_rate(hit: Column, weight: Column) -> Column:
    """Aggregate: the share of the weight that ``hit`` holds for."""
    return F.try_divide(F.sum(F.when(hit, weight).otherwise(F.lit(0.0))), F.sum(weight))


def sample_deviation(x: Column) -> Column:
    """Aggregate: sample standard deviation, 0 for fewer than two values."""
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(F.stddev_samp(x))


def nearest_rank(x: Column, q: float) -> Column:
    """Aggregate: the ``ceil(q n)``-th smallest value."""
    ordered = F.sort_array(F.collect_list(x))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(F.lit(1), F.ceil(F.size(ordered) * F.lit(q)).cast("int"))))


def adjusted_share(observed: Column, tpr: Column, fpr: Column, least_gap: float = 0.05) -> Column:
    """``(observed - fpr) / (tpr - fpr)`` within [0, 1]; null where the rates are too near."""
    raw = (observed - fpr) / (tpr - fpr)
    return F.when(tpr - fpr >= least_gap, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
