"""Panels: differences in differences, matched controls, trends and tests of the mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators.order import numbered
from sedimenta.plans.scratch import materialize

#: Units of a stratum whose draws are made at once, and places whose sums stand in one task.
CHUNK, PLACES = 2048, 16384


def contrasts(panel: DataFrame, adopters: DataFrame, *, unit: str, period: str, value: str, stratum: str, before: int = 1, after: int = 1) -> DataFrame:
    """Per adopter: its change from ``before`` to ``after`` its adoption less the mean change of its stratum's controls.

    Controls have no adoption, or adopt after the later period.  Control changes
    are added up by stratum, periods and adoption period first, so an adopter
    meets sums, not control rows.
    """
    a = adopters.select(unit, stratum, F.col("adopted").alias("adopted"))
    values = panel.select(unit, F.col(period).alias("p"), F.col(value).alias("v"))
    windows = a.filter("adopted is not null").select(stratum, (F.col("adopted") - before).alias("pre"), (F.col("adopted") + after).alias("post")).distinct()
    treated = (
        a.filter("adopted is not null")
        .select(unit, stratum, (F.col("adopted") - before).alias("pre"), (F.col("adopted") + after).alias("post"))
        .join(values.select(unit, F.col("p").alias("pre"), F.col("v").alias("v0")), [unit, "pre"])
        .join(values.select(unit, F.col("p").alias("post"), F.col("v").alias("v1")), [unit, "post"])
    )
    rows = values.join(a, unit)
    pre = windows.join(rows.select(stratum, unit, "adopted", F.col("p").alias("pre"), F.col("v").alias("v0")), [stratum, "pre"])
    both = pre.filter(F.col("adopted").isNull() | (F.col("adopted") > F.col("post"))).join(values.select(unit, F.col("p").alias("post"), F.col("v").alias("v1")), [unit, "post"])
    control = both.groupBy(stratum, "pre", "post").agg(F.avg(F.col("v1") - F.col("v0")).alias("control_change"), F.count("*").alias("controls"))
    joined = treated.join(control, [stratum, "pre", "post"])
    return joined.select(unit, stratum, "pre", "post", (F.col("v1") - F.col("v0")).alias("change"), "control_change", "controls", (F.col("v1") - F.col("v0") - F.col("control_change")).alias("effect"))


#: Controls that a cell of the grid should hold, about.
CELL_CONTROLS = 16


def nearest_controls(adopters: DataFrame, controls: DataFrame, *, unit: str, stratum: str, features: list[str], k: int = 5) -> DataFrame:
    """``(adopter, control, rank, distance)``: k nearest controls of the stratum, with replacement, features scaled by the stratum's population deviation.

    Each stratum has a grid over its first two features.  An adopter first meets the controls of its own
    and the adjoining cells; the k-th distance there bounds the cells that can hold a nearer one, and it
    meets just those.  Where too few are found at first, the bound is that of the whole grid.
    Rows with a null feature or stratum take no part.
    """
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    adopters, controls = adopters.filter(whole), controls.filter(whole)
    pooled = adopters.select(stratum, *features).unionByName(controls.select(stratum, *features))
    sd = pooled.groupBy(stratum).agg(*[F.stddev_pop(f).alias(f"__{f}") for f in features])
    scaled = [(F.col(f) / F.when(F.col(f"__{f}") > 0, F.col(f"__{f}")).otherwise(1.0)).alias(f"x{i}") for i, f in enumerate(features)]
    left = adopters.join(sd, stratum).select(stratum, F.col(unit).alias("adopter"), *scaled, *[F.col(f).alias(f"a_{f}") for f in features], *[f"__{f}" for f in features])
    right = controls.join(sd, stratum).select(stratum, F.col(unit).alias("control"), *scaled, *[F.col(f).alias(f"c_{f}") for f in features])
    axes = range(min(2, len(features)))
    ends = [e(f"x{i}").alias(f"{n}{i}") for i in axes for n, e in (("lo", F.min), ("hi", F.max))]
    cells = F.greatest(F.lit(1.0), F.pow(F.count("*") / CELL_CONTROLS, 1 / len(axes)))
    grid = right.groupBy(stratum).agg(*ends, F.ceil(cells).alias("cells"))

    def at(x: Column, i: int) -> Column:
        """The cell of a value, which may lie outside the grid: then that of the border."""
        width = (F.col(f"hi{i}") - F.col(f"lo{i}")) / F.col("cells")
        raw = F.when(width > 0, F.floor((x - F.col(f"lo{i}")) / width)).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col("cells") - 1, raw)).cast("int")

    def between(df: DataFrame, low: Callable, high: Callable) -> DataFrame:
        for i in axes:
            df = df.withColumn(f"cell{i}", F.explode(F.sequence(low(i), high(i))))
        return df

    held = right.join(grid, stratum).select(*right.columns, *[at(F.col(f"x{i}"), i).alias(f"cell{i}") for i in axes])
    asked = materialize(left.join(grid, stratum))
    key = [stratum, *[f"cell{i}" for i in axes]]
    terms = [F.pow((F.col(f"a_{f}") - F.col(f"c_{f}")) / F.when(F.col(f"__{f}") > 0, F.col(f"__{f}")).otherwise(1.0), 2) for f in features]
    distance = F.round(sum(terms[1:], terms[0]), 12)

    def best(cells: DataFrame) -> DataFrame:
        pairs = cells.join(held.drop(*[f"x{i}" for i in range(len(features))]), key).select("adopter", "control", distance.alias("distance"))
        return pairs.withColumn("rank", F.row_number().over(W.partitionBy("adopter").orderBy("distance", "control"))).filter(F.col("rank") <= k)

    def near(i: int, step: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("cells").cast("int") - 1, at(F.col(f"x{i}"), i) + step))

    first = best(between(asked, lambda i: near(i, -1), lambda i: near(i, 1)))
    bound = materialize(first.filter(F.col("rank") == k).select(F.col("adopter").alias("__adopter"), (F.sqrt("distance") * (1 + 1e-9) + 1e-6).alias("reach")))
    reached = asked.join(bound, F.col("adopter") == F.col("__adopter"), "left")
    all_cells = F.coalesce("reach", F.lit(float("inf")))
    return best(between(reached, lambda i: at(F.col(f"x{i}") - all_cells, i), lambda i: at(F.col(f"x{i}") + all_cells, i))).select("adopter", "control", "distance", "rank")


def mean_test(df: DataFrame, *, by: list[str], value: str, copies: Column | None = None) -> DataFrame:
    """``n, mean, t``: one-sample t of zero mean with multiplicities; t null for n < 2 or no variance."""
    m = F.lit(1) if copies is None else copies
    v = F.col(value)
    sums = df.groupBy(*by).agg(F.sum(m).alias("n"), F.sum(m * v).alias("s"), F.sum(m * v * v).alias("ss"))
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    return sums.select(*by, "n", mean.alias("mean"), F.when(var > 1e-12, mean / F.sqrt(var / F.col("n"))).alias("t"))


#: Fixed value: the two-sided 95 % point of the normal distribution.
Z = 1.959963984540054


def t_critical(df: Column) -> Column:
    """Two-sided 95 % point of Student's t for ``df`` degrees of freedom, by the expansion around the normal point."""
    terms = [(Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384]
    return sum((F.lit(t) / F.pow(df, i + 1) for i, t in enumerate(terms)), F.lit(Z))


def mean_zero_test(df: DataFrame, *, by: list[str], value: str, copies: Column | None = None) -> DataFrame:
    """``n, mean, t, critical, passed``: whether the mean may be zero.

    Fewer than two values pass only with a mean of zero; without variance a mean
    other than zero fails.
    """
    m = F.lit(1) if copies is None else copies
    v = F.col(value)
    rows = df.filter(v.isNotNull())
    sums = rows.groupBy(*by).agg(F.sum(m).alias("n"), F.try_divide(F.sum(m * v), F.sum(m)).alias("mean"), F.sum(m * v * v).alias("q"))
    var = F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1))
    out = sums.withColumn("var", F.when(F.col("n") > 1, F.when(var > 1e-12, var).otherwise(0.0)))
    t = F.when(F.col("var") > 0, F.abs("mean") / F.sqrt(F.col("var") / F.col("n"))).when(F.col("var") == 0, F.when(F.abs("mean") <= 1e-12, 0.0).otherwise(float("inf")))
    out = out.withColumn("t", t).withColumn("critical", F.when(F.col("n") > 1, t_critical(F.col("n") - 1)))
    return out.select(*by, "n", "mean", "t", "critical", F.when(F.col("n") > 1, F.col("t") <= F.col("critical")).otherwise(F.abs("mean") <= 1e-12).alias("passed"))


def bootstrap_effects(effects: DataFrame, draws: DataFrame, *, unit: str, by: list[str], effect: str) -> DataFrame:
    """Percentile interval of the mean effect of each stratum over whole-unit resamples; units that were not drawn do not count."""
    each = effects.join(draws, unit).groupBy("replicate", *by).agg((F.sum(F.col(effect) * F.col("copies")) / F.sum("copies")).alias("mean"))
    return each.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def drawn_effects(effects: DataFrame, *, unit: str, stratum: str, effect: str, replicates: int, seed: str) -> DataFrame:
    """:func:`bootstrap_effects` over the draws of :func:`order.stratified_draws` of one stratum column, without a row for each draw.

    Draws are made in chunks and travel as two bytes each to the range of places that holds their unit;
    there they meet the sums of ``PLACES`` units, and leave a sum for each replicate.
    """
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("null"))
    sums = effects.groupBy(stratum, unit).agg(F.coalesce(F.sum(effect), F.lit(0.0)).cast("double").alias("__e"), F.count("*").cast("double").alias("__m"))
    placed = materialize(numbered(sums, order=[unit], by=[stratum], name="__place"))
    sizes = placed.groupBy(stratum).agg(F.count("*").alias("n"))
    chunks = sizes.select(stratum, name.alias("name"), "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    kind = effects.schema[stratum].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, text, n, chunk in frame.itertuples(index=False, name=None):
                tails = [str(j).encode() for j in range(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))]
                place = np.empty((replicates, len(tails)), np.int64)
                for b in range(replicates):
                    head = f"{seed}\0{text}\0{b}\0".encode()
                    digests = np.frombuffer(b"".join([sha256(head + t).digest() for t in tails]), np.uint8).reshape(-1, 32)
                    place[b] = (digests[:, :6].astype(np.int64) @ (1 << np.arange(40, -1, -8, dtype=np.int64))) % n
                part = place // PLACES
                counts = np.bincount((part + np.arange(replicates)[:, None] * (part.max() + 1)).ravel(), minlength=replicates * (part.max() + 1)).reshape(replicates, -1)
                inside = (place - part * PLACES).astype(np.uint16).ravel()[np.argsort(part.ravel(), kind="stable")]
                ends = np.cumsum(counts.sum(axis=0))
                for k in np.flatnonzero(counts.any(axis=0)):
                    held = inside[ends[k] - counts[:, k].sum() : ends[k]]
                    yield pd.DataFrame({"stratum": [own], "part": [int(k)], "counts": [counts[:, k].astype(np.int32).tobytes()], "places": [held.tobytes()]})

    def add(units: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        value, rows = np.zeros(PLACES), np.zeros(PLACES)
        at = units["__place"].to_numpy(np.int64) % PLACES
        value[at], rows[at] = units["__e"], units["__m"]
        total = np.zeros((2, replicates))
        for counts, places in zip(draws["counts"], draws["places"], strict=True):
            replicate, place = np.repeat(np.arange(replicates), np.frombuffer(counts, np.int32)), np.frombuffer(places, np.uint16)
            total[0] += np.bincount(replicate, weights=value[place], minlength=replicates)
            total[1] += np.bincount(replicate, weights=rows[place], minlength=replicates)
        hit = np.flatnonzero(total[1])
        return pd.DataFrame({"stratum": [draws["stratum"].iloc[0] if len(draws) else None] * len(hit), "replicate": hit, "s": total[0, hit], "m": total[1, hit]})

    tasks = min(chunks.count() or 1, 10_000)
    made = chunks.repartition(tasks).mapInPandas(draw, f"stratum {kind}, part long, counts binary, places binary")
    units = placed.withColumn("__part", F.floor(F.col("__place") / PLACES))
    each = units.groupBy(stratum, "__part").cogroup(made.groupBy("stratum", "part")).applyInPandas(add, f"stratum {kind}, replicate int, s double, m double")
    means = each.groupBy(F.col("stratum").alias(stratum), "replicate").agg((F.sum("s") / F.sum("m")).alias("mean"))
    return means.groupBy(stratum).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def mean_shift(df: DataFrame, *, by: list[str], side: Column, value: str, weight: Column) -> DataFrame:
    """Difference of the weighted means of two sides in pooled weighted population deviations; null if there is none."""
    v = F.col(value)

    def moments(on: Column, name: str) -> list[Column]:
        w = F.when(on, weight).otherwise(0.0)
        return [F.sum(w).alias(f"w{name}"), F.sum(w * v).alias(f"s{name}"), F.sum(w * v * v).alias(f"q{name}")]

    m = df.groupBy(*by).agg(*moments(side, "1"), *moments(~side, "0"))
    mean = {s: F.try_divide(f"s{s}", f"w{s}") for s in "10"}
    var = {s: F.try_divide(f"q{s}", f"w{s}") - mean[s] * mean[s] for s in "10"}
    pooled = F.sqrt(F.greatest(F.lit(0.0), (var["1"] + var["0"]) / 2))
    return m.select(*by, F.when(pooled > 1e-12, (mean["1"] - mean["0"]) / pooled).alias("shift"))


def trend_ceiling(df: DataFrame, *, period: str, rate: Column, weight: Column, target: int, least: float, ceiling: float = 0.95) -> DataFrame:
    """Rate expected at ``target``: the larger of a line through the periods and the mean of the last three, at most ``ceiling``.

    Periods of less weight than ``least`` do not count; null with fewer than three.
    """
    per = df.groupBy(period).agg(F.try_divide(F.sum(rate * weight), F.sum(weight)).alias("r"), F.sum(weight).alias("w")).filter(F.col("w") >= least)
    ranked = per.withColumn("k", F.row_number().over(W.orderBy(F.desc(period))))  # one row a period
    fit = ranked.agg(
        F.count("*").alias("periods"),
        (F.regr_intercept("r", F.col(period)) + F.regr_slope("r", F.col(period)) * target).alias("line"),
        F.avg(F.when(F.col("k") <= 3, F.col("r"))).alias("recent"),
    )
    return fit.select("periods", F.when(F.col("periods") >= 3, F.least(F.lit(ceiling), F.greatest("line", "recent"))).alias("rate"))
