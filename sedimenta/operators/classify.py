"""Weighted ridge logistic regression by Newton steps over aggregated sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Logit:
    """A fitted model on standardized features."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def score(self) -> Column:
        """Probability as a column of built-in functions."""
        z = F.lit(float(self.beta[0]))
        for f, m, s, b in zip(self.features, self.mean, self.scale, self.beta[1:], strict=True):
            z = z + F.lit(float(b)) * (F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))
        return 1 / (1 + F.exp(-z))


def fit_logit(df: DataFrame, *, features: list[str], label: Column, weight: Column, ridge: float = 1.0, rounds: int = 40, tolerance: float = 1e-7) -> Logit:
    """Newton steps with an unpenalized intercept; weights are scaled to mean 1.

    A step is one aggregation of ``(p + 1)(p + 2) / 2 + p + 1`` sums; the driver
    solves a system of ``p + 1`` unknowns.
    """
    stats = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)], F.avg(weight).alias("w")).first()
    p = len(features)
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([s if (s := stats[f"s{i}"] or 0.0) > 1e-9 else 1.0 for i in range(p)])
    model = Logit(features, mean, scale, np.zeros(p + 1))
    x = [F.lit(1.0), *[(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, scale, strict=True)]]
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], label.cast("double").alias("y"), (weight / F.lit(float(stats["w"] or 1.0))).alias("w"))
    penalty = np.diag([0.0] + [ridge] * p)
    for _ in range(rounds):
        z = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(model.beta)), F.lit(0.0))
        prob = 1 / (1 + F.exp(-z))
        scored = rows.withColumn("r", F.col("w") * (F.col("y") - prob)).withColumn("h", F.col("w") * prob * (1 - prob))
        sums = scored.agg(
            *[F.sum(F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(p + 1)],
            *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i + 1)],
        ).first()
        g = np.array([sums[f"g{i}"] for i in range(p + 1)]) - penalty @ model.beta
        h = np.array([[sums[f"h{max(i, j)}_{min(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + penalty
        step = np.linalg.solve(h + 1e-12 * np.eye(p + 1), g)
        model.beta = model.beta + step
        if np.abs(step).max() < tolerance:
            break
    return model


def out_of_fold(df: DataFrame, *, fold: str, k: int, features: list[str], label: Column, weight: Column, ridge: float = 1.0) -> DataFrame:
    """Adds ``score``: each row by the model fitted on the other folds.  ``k`` is small; every fit is a few aggregations."""
    parts = []
    for f in range(k):
        model = fit_logit(df.filter(F.col(fold) != f), features=features, label=label, weight=weight, ridge=ridge)
        parts.append((f, model.score()))
    score = F.lit(None).cast("double")
    for f, s in parts:
        score = F.when(F.col(fold) == f, s).otherwise(score)
    return df.withColumn("score", score)
