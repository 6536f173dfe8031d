"""From labelled reference rows to the share of a class among target rows, cross-fitted, with its gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.stats import adjusted_share
from sedimenta.operators.boosting import Boosted, boost_many, thresholds
from sedimenta.operators.order import numbered
from sedimenta.operators.quantify import best_threshold, same_keys, weighted_auc
from sedimenta.operators.refit import LEAST_VARIATION, Block, Fits, counted, few_rows, fit_many, likeliest_shares, packed, quantile_edges, streamed, summed
from sedimenta.plans.scratch import discard, materialize

#: Gates of an estimate: least AUC, largest misfit of the mixture, largest difference of the two estimators.
LEAST_AUC, MOST_MISFIT, MOST_DISAGREEMENT = 0.70, 0.10, 0.10


def _fitted(
    reference: DataFrame, others: DataFrame, *, group: str, features: list[str], label: str, weight: str, kind: str, folds: int, ridge: float, rounds: int
) -> tuple[DataFrame, Fits | Boosted, DataFrame]:
    """Blocks of the reference rows, whose units are folds, a model without each fold and one of all, and ``(group, __fold)``; ``others`` are the target's groups."""
    names = materialize(reference.select(group).distinct())
    if not same_keys(names, others, [group]).isEmpty():
        raise ValueError("reference and target share groups")
    # a written table of groups has a known size, so Spark need not shuffle the rows to meet it
    fold = materialize(numbered(names, order=[group], name="__place").select(group, (F.col("__place") % folds).cast("int").alias("__fold")))
    discard(names)
    held = np.column_stack((1 - np.eye(folds, dtype=np.uint16), np.ones(folds, np.uint16)))
    blocks = streamed(same_keys(reference, fold, [group]), F.col("__fold"), held, features=features, label=F.col(label).cast("int"), weight=F.col(weight))
    if kind == "logistic":
        fits = fit_many(blocks, features=features, models=folds + 1, ridge=ridge)
    elif kind == "trees":
        fits = boost_many(blocks, thresholds(reference, features), features=features, models=folds + 1, rounds=rounds)
    else:
        raise ValueError(f"no such model: {kind}")
    if fits.failed.any():
        raise ValueError("a fold lacks a class")
    return blocks, fits, fold


def crossfit(
    reference: DataFrame, target: DataFrame, *, group: str, features: list[str], label: str, weight: str, kind: str = "logistic", folds: int = 5, ridge: float = 3.0, rounds: int = 100
) -> tuple[DataFrame, DataFrame]:
    """``(group, label, weight, score)`` of the reference rows, out of fold, and ``(group, weight, score)`` of the target rows, by a model of all reference rows.

    Groups are dealt to folds in sorted order; all models are fitted side by side.
    ``kind`` is ``logistic`` or ``trees``.  A group on both sides, or a fold whose other folds lack a
    class, is an error.
    """
    blocks, fits, fold = _fitted(reference, target.select(group).distinct(), group=group, features=features, label=label, weight=weight, kind=kind, folds=folds, ridge=ridge, rounds=rounds)
    discard(blocks)

    def scored(df: DataFrame, model: Column, own: list[str]) -> DataFrame:
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x, number = frame[[f"__x{i}" for i in range(len(features))]].to_numpy(np.float64), frame["__model"].to_numpy()
                score = np.zeros(len(x))
                for k in np.unique(number):  # a row meets its own model only
                    score[number == k] = fits.scores(x[number == k], slice(k, k + 1))[:, 0]
                yield frame[own].assign(score=score)

        x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, f in enumerate(features)]
        return df.filter(F.col(weight) > 0).select(*own, *x, model.alias("__model")).mapInPandas(run, f"{kinds}, score double")

    # a group's own fold has just the model that has not seen it
    held = same_keys(reference, fold, [group])
    return scored(held, F.col("__fold"), [group, label, weight]), scored(target, F.lit(folds), [group, weight])


def histogram_edges(scored: DataFrame, *, weight: str, bins: int) -> np.ndarray:
    """Distinct inner edges of bins of equal weight over scores in [0, 1]."""
    blocks = streamed(scored, F.lit(0), np.ones((1, 1)), features=["score"], label=F.lit(0), weight=F.col(weight))
    edges = quantile_edges(blocks, _scores, features=1, replicates=1, bins=bins)[0]
    discard(blocks)
    return edges


def _scores(b: Block) -> Iterator[tuple]:
    """The entries of blocks whose one feature is the score."""
    yield 0, np.arange(len(b.y)), b.x[:, 0], b.w


def out_of_fold(blocks: DataFrame, fits: Fits | Boosted, *, features: int, folds: int) -> DataFrame:
    """``blocks`` of :func:`_fitted` with the score of the model without the row's fold as their one feature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                b = Block.unpack(row, features)
                own = b.copies[:, :folds].argmin(axis=1)  # the fold that lacks the unit
                score = np.concatenate([fits.scores(b.x[at], slice(own[unit], own[unit] + 1))[:, 0] for unit, at in b.runs()])
                one = {"n": row.n, "units": 1, "x": score.tobytes(), "y": row.y, "w": row.w, "unit": np.zeros(row.n, np.int32).tobytes(), "copies": np.ones((1, 1), np.uint16).tobytes()}
                yield pd.DataFrame({k: [v] for k, v in one.items()})

    with few_rows(blocks.sparkSession, 4):
        return materialize(blocks.mapInPandas(run, "n int, units int, x binary, y binary, w binary, unit binary, copies binary"))


def scored_bins(df: DataFrame, fits: Fits | Boosted, model: int, edges: np.ndarray, *, group: str, features: list[str], weight: str) -> DataFrame:
    """``group, bin, w`` of rows of positive weight scored by one model; a score on an edge belongs to the bin above it."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, f in enumerate(features)]
    names = [f"__x{i}" for i in range(len(features))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = fits.scores(frame[names].to_numpy(np.float64), slice(model, model + 1))[:, 0]
            yield pd.DataFrame({group: frame[group], "bin": np.searchsorted(edges, score, side="right").astype(np.int32), "w": frame["__w"]})

    kind = df.schema[group].dataType.simpleString()
    placed = df.filter(F.col(weight) > 0).select(group, *x, F.col(weight).cast("double").alias("__w")).mapInPandas(run, f"`{group}` {kind}, bin int, w double")
    return placed.groupBy(group, "bin").agg(F.sum("w").alias("w"))


def in_bins(df: DataFrame, edges: np.ndarray, *, by: list[str], weight: str) -> DataFrame:
    """Weight by ``by`` and ``bin``; a score on an edge belongs to the bin above it."""
    at = sum((F.when(F.col("score") >= float(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.groupBy(*by, at.alias("bin")).agg(F.sum(weight).alias("w"))


def _dense(rows: list, bins: int, of: Callable = lambda r: r.w) -> np.ndarray:
    out = np.zeros(bins)
    for r in rows:
        out[r.bin] += of(r)
    return out


def quantified(reference: DataFrame, target: DataFrame, *, group: str, label: str, weight: str, bins: int = 20) -> dict[str, DataFrame]:
    """``point``: one row with both estimates of the share, AUC and gates; ``omitted``: the share without each target group.

    Takes the two tables of :func:`crossfit`.  Groups are left out of the
    target's histogram, so no model is fitted again.
    """
    spark = reference.sparkSession
    reference, target = materialize(reference), materialize(target)
    edges = histogram_edges(reference, weight=weight, bins=bins)
    if not len(edges):
        raise ValueError("reference scores are indistinguishable")
    size = len(edges) + 1
    sides = in_bins(reference, edges, by=[label], weight=weight).collect()  # at most two rows a bin
    agent, human = (_dense([r for r in sides if r[label] == y], size) + 0.5 for y in (1, 0))
    agent, human = agent / agent.sum(), human / human.sum()
    if 0.5 * np.abs(agent - human).sum() < LEAST_VARIATION:
        raise ValueError("reference score distributions are indistinguishable")
    groups = materialize(in_bins(target, edges, by=[group], weight=weight))
    total = _dense(groups.groupBy("bin").agg(F.sum("w").alias("w")).collect(), size)
    share = float(likeliest_shares(agent[None], human[None], total[None])[0])
    misfit = float(0.5 * np.abs(total / total.sum() - share * agent - (1 - share) * human).sum())

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row = np.repeat(np.arange(len(frame)), frame["bins"].str.len())
            own = np.zeros((len(frame), size))
            if len(row):
                np.add.at(own, (row, np.concatenate(frame["bins"].to_list())), np.concatenate(frame["ws"].to_list()))
            rest = np.maximum(total - own, 0)
            value = np.where(rest.sum(axis=1) > 1e-9 * total.sum(), likeliest_shares(agent[None], human[None], rest), np.nan)
            yield pd.DataFrame({group: frame[group], "share": value, "shift": np.abs(value - share)})

    kind = groups.schema[group].dataType.simpleString()
    # a group is one row, so that many are left out at once
    held = groups.groupBy(group).agg(F.collect_list(F.struct("bin", "w")).alias("__held")).select(group, F.col("__held.bin").alias("bins"), F.col("__held.w").alias("ws"))
    omitted = held.mapInPandas(leave, f"`{group}` {kind}, share double, shift double").select(group, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("share", "shift")])
    is_agent, w = F.col(label) == 1, F.col(weight)
    auc = weighted_auc(reference, score="score", label=is_agent, weight=w)
    cut = best_threshold(reference, score="score", label=is_agent, weight=w)
    hit = target.join(F.broadcast(cut.select("threshold"))).agg((F.sum(F.when(F.col("score") >= F.col("threshold"), w).otherwise(0.0)) / F.sum(w)).alias("observed"))
    both = auc.join(cut).join(hit).select("auc", "threshold", adjusted_share(F.col("observed"), F.col("tpr"), F.col("fpr")).alias("adjusted"))
    point = both.select(
        F.lit(share).alias("share"), "adjusted", F.abs(F.lit(share) - F.col("adjusted")).alias("disagreement"), F.lit(misfit).alias("misfit"), "auc", "threshold",
        (F.col("auc") >= LEAST_AUC).alias("auc_passed"), F.lit(misfit <= MOST_MISFIT).alias("mixture_passed"), (F.abs(F.lit(share) - F.col("adjusted")) <= MOST_DISAGREEMENT).alias("agreement_passed"),
    )
    return {"point": point.withColumn("identified", F.col("auc_passed") & F.col("mixture_passed") & F.col("agreement_passed")), "omitted": omitted}


def mixture_grid(
    reference: DataFrame, target: DataFrame, draws: DataFrame, *, stratum: str, by: list[str], group: str, label: str, weight: str, bins: int = 20, least_groups: int = 5
) -> DataFrame:
    """``by, stratum, weighting, groups, share, low, high, misfit, replicates, status`` of every cell of scored targets.

    Reference scores of a ``stratum`` (say a language) are cut at their own pooled weighted quantiles; strata are
    few.  ``weighting`` is ``line`` (rows weigh as they do) or ``repository`` (every group of a cell weighs alike).
    ``draws`` (``replicate, group, copies``) gives the interval.  Rows are counted by group and bin
    once, and all shares of a cell are found together.  The status is ``identified``, or why there is no share.
    """
    spark = reference.sparkSession
    strata = [r[0] for r in reference.select(stratum).distinct().orderBy(stratum).collect()]
    kind = reference.schema[stratum].dataType.simpleString()
    models = spark.createDataFrame([(s, i, 1) for i, s in enumerate(strata)], f"`{stratum}` {kind}, model int, copies int")
    blocks = packed(reference, models, unit=[stratum], features=["score"], label=F.col(label).cast("int"), weight=F.col(weight), models=len(strata))

    def entries(b: Block) -> Iterator[tuple]:
        for i in range(len(strata)):
            yield i, np.arange(len(b.y)), b.x[:, 0], b.w * b.copies[b.unit, i]

    edges = quantile_edges(blocks, entries, features=1, replicates=len(strata), bins=bins)
    discard(blocks)
    cuts = spark.createDataFrame([(s, [float(x) for x in e]) for s, e in zip(strata, edges, strict=True)], f"`{stratum}` {kind}, __edges array<double>")

    def binned(df: DataFrame) -> DataFrame:
        at = F.size(F.filter("__edges", lambda e: e <= F.col("score")))
        return df.filter(F.col(weight) > 0).join(F.broadcast(cuts), stratum, "left").withColumn("bin", F.when(F.col("__edges").isNotNull(), at))

    shapes: dict = {}
    for r in binned(reference).groupBy(stratum, label, "bin").agg(F.sum(weight).alias("w")).collect():  # two rows a stratum and bin
        size = len(edges[strata.index(r[stratum])]) + 1
        shapes.setdefault(r[stratum], np.full((2, size), 0.5))[int(r[label]), r.bin] += r.w
    shapes = {s: v / v.sum(axis=1, keepdims=True) for s, v in shapes.items()}
    cell = [*by, stratum]
    per = materialize(binned(target).groupBy(*cell, group, "bin").agg(F.sum(weight).alias("line")))
    whole = per.groupBy(*cell, group).agg(F.sum("line").alias("__all"))
    both = same_keys(per, whole, [*cell, group]).withColumn("repository", F.col("line") / F.col("__all"))
    long = materialize(both.unpivot([*cell, group, "bin"], ["line", "repository"], "weighting", "w"))
    once = long.groupBy(*cell, "weighting", "bin").agg(F.sum("w").alias("w")).withColumn("replicate", F.lit(-1))
    drawn = long.join(draws, group).groupBy(*cell, "weighting", "bin", "replicate").agg(F.sum(F.col("w") * F.col("copies")).alias("w"))
    groups = per.groupBy(*cell).agg(F.count_distinct(group).alias("groups"))

    def shares(frame: pd.DataFrame) -> pd.DataFrame:
        head, shape = frame.iloc[:1], shapes.get(frame[stratum].iloc[0])
        out = head[[*cell, "weighting"]].assign(share=None, low=None, high=None, misfit=None, replicates=0, reason=None)
        if shape is None:
            return out.assign(reason="no_reference")
        if shape.shape[1] < 2 or 0.5 * np.abs(shape[1] - shape[0]).sum() < LEAST_VARIATION:
            return out.assign(reason="reference_indistinguishable")
        numbers, row = np.unique(frame["replicate"], return_inverse=True)
        counts = np.zeros((len(numbers), shape.shape[1]))
        np.add.at(counts, (row, frame["bin"].to_numpy(np.int64)), frame["w"].to_numpy())
        found = likeliest_shares(shape[1][None], shape[0][None], counts)
        own, rest = found[numbers == -1][0], found[numbers != -1]
        goal = counts[numbers == -1][0]
        misfit = 0.5 * np.abs(goal / goal.sum() - own * shape[1] - (1 - own) * shape[0]).sum()
        low, high = np.percentile(rest, [2.5, 97.5]) if len(rest) else (None, None)
        return out.assign(share=own, low=low, high=high, misfit=misfit, replicates=len(rest))

    kinds = ", ".join(f"`{c}` {target.schema[c].dataType.simpleString()}" for c in cell)
    made = once.unionByName(drawn).groupBy(*cell, "weighting").applyInPandas(shares, f"{kinds}, weighting string, share double, low double, high double, misfit double, replicates int, reason string")
    out = same_keys(made, groups, cell)
    few = F.col("groups") < least_groups
    status = F.coalesce("reason", F.when(few, "too_few_groups"), F.when(F.col("misfit") > MOST_MISFIT, "mixture_does_not_fit"), F.lit("identified"))
    return out.select(*cell, "weighting", "groups", "share", *[F.when(~few, F.col(c)).alias(c) for c in ("low", "high")], "misfit", "replicates", status.alias("status"))


def recovery(groups: DataFrame, shape: np.ndarray, *, group: str, shares: list[float], trials: int, picks: int, replicates: int, seed: str) -> DataFrame:
    """``share, error, worst, bias, coverage, trials``: how well known shares are found again in mixtures of whole groups.

    ``groups`` has ``group, side`` (1 or 0), ``bin, w``; ``shape`` the bins' probabilities of both sides, 0 first.  In
    each trial ``picks`` groups of each side are drawn with replacement by digest and mixed in each share.
    The interval of a trial resamples its drawn groups ``replicates`` times; coverage is how often it holds the
    share.  A trial's task sees the histograms of its drawn groups only.
    """
    spark = groups.sparkSession
    placed = numbered(groups.select("side", group).distinct(), order=[group], by=["side"], name="place")
    sizes = placed.groupBy("side").agg(F.count("*").alias("n"))
    picked = spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("pick")).join(F.broadcast(sizes))  # two rows
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), *[F.col(c).cast("string") for c in ("trial", "side", "pick")]).cast("binary"), 256)
    drawn = picked.withColumn("place", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")).drop("n")
    rows = drawn.join(placed, ["side", "place"]).join(groups.groupBy("side", group, "bin").agg(F.sum("w").alias("w")), ["side", group])
    agent, human = shape[1], shape[0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        trial = int(frame["trial"].iloc[0])
        held = np.zeros((2, picks, len(agent)))
        np.add.at(held, (frame["side"].to_numpy(), frame["pick"].to_numpy(), frame["bin"].to_numpy()), frame["w"].to_numpy())
        rng = np.random.default_rng([trial, *seed.encode()])
        times = np.concatenate((np.ones((1, 2, picks)), rng.multinomial(picks, np.full(picks, 1 / picks), size=(replicates, 2))))
        sums = np.einsum("rsp,spb->rsb", times, held)
        sums = sums / np.maximum(sums.sum(axis=2, keepdims=True), 1e-300)
        out = []
        for share in shares:
            found = likeliest_shares(agent[None], human[None], share * sums[:, 1] + (1 - share) * sums[:, 0])
            low, high = np.percentile(found[1:], [2.5, 97.5])
            out.append((trial, share, found[0] - share, low - 1e-9 <= share <= high + 1e-9))
        return pd.DataFrame(out, columns=["trial", "share", "off", "held"])

    each = rows.groupBy("trial").applyInPandas(run, "trial int, share double, off double, held boolean")
    off = F.abs("off")
    return each.groupBy("share").agg(F.avg(off).alias("error"), F.max(off).alias("worst"), F.avg("off").alias("bias"), F.avg(F.col("held").cast("double")).alias("coverage"), F.count("*").alias("trials"))


def dedicated_validation(
    reference: DataFrame, validation: DataFrame, *, group: str, features: list[str], label: str, weight: str, shares: list[float], trials: int, picks: int, replicates: int, seed: str, bins: int = 20, kind: str = "logistic"
) -> DataFrame:
    """:func:`recovery` on groups that no model has seen: fitted on the references only, scored on validation groups of one label each.

    A group on both sides, a validation group with both labels, or a side without groups is an error.
    """
    weighs = F.col(weight) > 0
    own = F.when(weighs, F.col(label))
    every = materialize(validation.groupBy(group).agg(F.min(own).cast("int").alias("side"), F.max(own).cast("int").alias("__most"), F.count_if(weighs).alias("__n")))
    sides = every.filter("__n > 0")
    kinds = {r.side for r in sides.select("side").distinct().collect()}
    if not sides.filter("side <> __most or side is null").isEmpty():
        raise ValueError("a validation group has conflicting labels")
    if kinds != {0, 1}:
        raise ValueError("validation needs groups of both labels")
    folds = 5
    blocks, fits, fold = _fitted(reference, every.select(group), group=group, features=features, label=label, weight=weight, kind=kind, folds=folds, ridge=3.0, rounds=100)
    # the references are read once: their scores are made from the blocks and stay in blocks
    scored = out_of_fold(blocks, fits, features=len(features), folds=folds)
    discard(blocks, fold)
    edges = quantile_edges(scored, _scores, features=1, replicates=1, bins=bins)[0]
    size = len(edges) + 1
    shape = summed(scored, 1, 1, counted(_scores, [edges], 1, size, True), whole=True).reshape(2, size)[::-1] + 0.5
    discard(scored)
    shape = shape / shape.sum(axis=1, keepdims=True)
    if len(edges) < 1 or 0.5 * np.abs(shape[1] - shape[0]).sum() < LEAST_VARIATION:
        raise ValueError("reference score distributions are indistinguishable")
    binned = scored_bins(validation, fits, folds, edges, group=group, features=features, weight=weight)
    groups = materialize(same_keys(binned, sides.select(group, "side"), [group]))
    return recovery(groups, shape, group=group, shares=shares, trials=trials, picks=picks, replicates=replicates, seed=seed)
