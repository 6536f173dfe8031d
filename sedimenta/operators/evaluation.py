"""Evaluation of scores: held-out groups and eras, fits by stratum, grids of cells, and power."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.stats import adjusted_share
from sedimenta.operators.classify import fit_logit
from sedimenta.operators.panel import t_critical
from sedimenta.operators.quantify import rates_at, same_keys, weighted_auc
from sedimenta.operators.refit import fit_many, own_scores, packed
from sedimenta.plans.scratch import discard


def class_balance(df: DataFrame, label: Column) -> DataFrame:
    """Adds ``balance``: the rows over twice the rows of the own class, so that both classes weigh alike."""
    n = df.agg(F.count("*").alias("__n"), F.count_if(label).alias("__p"))  # one row
    return df.join(F.broadcast(n)).withColumn("balance", F.try_divide("__n", 2 * F.when(label, F.col("__p")).otherwise(F.col("__n") - F.col("__p")))).drop("__n", "__p")


def _numbered(df: DataFrame, column: str, values: list) -> DataFrame:
    """``column, model``: a number for each of the listed values."""
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{column}` {kind}, model int")


def _listed(df: DataFrame, models: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` has a number."""
    return same_keys(df, F.broadcast(models.select(column)), [column])


def left_out_groups(df: DataFrame, *, group: str, groups: list, features: list[str], label: Column, ridge: float = 1.0) -> DataFrame:
    """``group, auc, rows``: each of the listed groups scored by a class-balanced fit on all other rows; ``auc`` is null where that fit has failed.

    All fits go together, one pass a step; a group weighs nothing in its own model.
    """
    models = _numbered(df, group, groups)
    units = df.select(group).distinct().withColumn("__unit", F.lit(True))
    others = units.join(F.broadcast(models.select(F.col(group).alias("__own"), "model")), ~F.col(group).eqNullSafe(F.col("__own"))).select(group, "model", F.lit(1).alias("copies"))
    blocks = packed(df, others, unit=[group], features=features, label=label, weight=F.lit(1.0), models=len(groups))
    fits = fit_many(blocks, features=features, models=len(groups), ridge=ridge, balanced=True)
    discard(blocks)
    scored = own_scores(_listed(df, models, group), fits, models, on=group)
    auc = weighted_auc(scored.filter("score is not null"), score="score", label=label, weight=F.lit(1.0), by=[group])
    rows = same_keys(models, scored.groupBy(group).agg(F.count("*").alias("rows")), [group], "left")
    return same_keys(rows, auc, [group], "left").select(group, "auc", F.coalesce("rows", F.lit(0)).alias("rows"))


def era_holdout(df: DataFrame, *, late: Column, features: list[str], label: Column, ridge: float = 1.0) -> DataFrame:
    """``auc, rows`` of the late rows under a class-balanced fit on the early ones."""
    model = fit_logit(class_balance(df.filter(~late), label), features=features, label=label, weight=F.col("balance"), ridge=ridge)
    rows = df.filter(late).withColumn("score", model.score())
    return weighted_auc(rows, score="score", label=label, weight=F.lit(1.0)).join(rows.agg(F.count("*").alias("rows")))


def fits_by_stratum(df: DataFrame, *, stratum: str, strata: list | None = None, features: list[str], label: Column, weight: Column, threshold: float = 0.5, least_auc: float = 0.7, least_rows: int = 50) -> DataFrame:
    """One fit a listed stratum (if none are listed, of each there is), all together, with its rates, and the reason why it may not be used, null if it may.

    Every stratum has its row: where its fit has failed, for want of a class, the rates are null.
    """
    if strata is None:
        strata = [r[0] for r in df.select(stratum).distinct().collect()]  # a row a model
    models = _numbered(df, stratum, strata)
    blocks = packed(df, models.withColumn("copies", F.lit(1)), unit=[stratum], features=features, label=label, weight=weight, models=len(strata))
    fits = fit_many(blocks, features=features, models=len(strata))
    discard(blocks)
    rows = _listed(df, models, stratum)
    counts = rows.groupBy(stratum).agg(F.count_if(label).alias("positive"), F.count_if(~label).alias("negative"))
    scored = own_scores(rows, fits, models, on=stratum).filter("score is not null")
    rates = rates_at(scored, score="score", label=label, weight=weight, threshold=F.lit(threshold), by=[stratum])
    out = same_keys(models.select(stratum, F.col("model").isin([i for i, failed in enumerate(fits.failed) if failed]).alias("__failed")), counts, [stratum], "left").fillna(0, ["positive", "negative"])
    for found in (weighted_auc(scored, score="score", label=label, weight=weight, by=[stratum]), rates):
        out = same_keys(out, found, [stratum], "left")
    reason = F.when(F.least("positive", "negative") < least_rows, "too_few_rows").when(F.col("__failed"), "fit_failed")
    reason = reason.when(~F.coalesce(F.col("auc") >= least_auc, F.lit(False)), "auc_below_gate").when(F.col("tpr") - F.col("fpr") < 0.05, "rates_too_near")
    return out.select(stratum, "positive", "negative", "auc", "tpr", "fpr", reason.alias("reason"))


def prevalence_grid(targets: DataFrame, rates: DataFrame, *, by: list[str], group: str, lines: str, hit: Column, on: str, least_groups: int) -> DataFrame:
    """Share of each cell and weighting, corrected for its rates, with a status.

    ``weighting`` is ``line`` (every line counts) or ``repository`` (every group
    counts alike).  ``rates`` has ``tpr`` and ``fpr`` by ``on``.  Rows are summed by
    group first, so the weightings are taken from sums.
    """
    per = targets.groupBy(*by, group).agg(F.sum(lines).alias("l"), F.sum(F.when(hit, F.col(lines)).otherwise(0)).alias("h"))
    cells = per.groupBy(*by).agg(F.count("*").alias("groups"), F.try_divide(F.sum("h"), F.sum("l")).alias("line"), F.avg(F.try_divide("h", "l")).alias("repository"))
    long = cells.unpivot([*by, "groups"], ["line", "repository"], "weighting", "observed").join(F.broadcast(rates.select(on, "tpr", "fpr")), on, "left")
    status = F.when(F.col("tpr").isNull(), "no_rates").when(F.col("groups") < least_groups, "too_few_groups").when(F.col("tpr") - F.col("fpr") < 0.05, "rates_too_near").otherwise("identified")
    out = long.withColumn("status", status)
    return out.withColumn("share", F.when(F.col("status") == "identified", adjusted_share(F.col("observed"), F.col("tpr"), F.col("fpr"))))


def paired_power(spark: SparkSession, *, least: int, most: int, effect: float, correlation: float, target: float, replicates: int, seed: str) -> DataFrame:
    """``n, power, selected``: Monte-Carlo power of a paired t test for ``n`` pairs; ``selected`` marks the smallest that reaches the target.

    Normal draws come from digests, so reruns agree; the draws of a replicate are
    added up where they are made.
    """
    runs = spark.range(least, most + 1).select(F.col("id").alias("n")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = runs.repartition("n", "replicate").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    u = lambda k: (F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(seed), F.col("n").cast("string"), F.col("replicate").cast("string"), F.col("i").cast("string"), F.lit(k)).cast("binary"), 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    value = F.lit(effect) + F.lit(math.sqrt(2 * (1 - correlation))) * F.sqrt(-2 * F.log(u("a"))) * F.cos(F.lit(2 * math.pi) * u("b"))
    per = draws.withColumn("v", value).groupBy("n", "replicate").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    found = F.abs(F.col("mean") / (F.col("sd") / F.sqrt("n"))) >= t_critical(F.col("n") - 1)
    power = per.groupBy("n").agg(F.avg(found.cast("double")).alias("power"))
    first = F.min(F.when(F.col("power") >= target, F.col("n"))).over(W.partitionBy())  # one row a number of pairs
    return power.withColumn("selected", F.coalesce(F.col("n") == first, F.lit(False)))
