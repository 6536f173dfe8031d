"""Score-based estimates: AUC, rates, thresholds, mixtures, agreement and envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.plans.scratch import materialize

#: Tasks, about, that the rows of one group are dealt to where they meet a row of that group.
SALTS = 32


def same_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on ``on`` (inner, or ``how``: left), null keys equal to null, with one copy of the keys."""
    if not on:
        return left.join(F.broadcast(right))
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    hit = F.lit(True)
    for c in on:
        hit = hit & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(other, hit, how).drop(*[f"__r_{c}" for c in on])


def with_before(df: DataFrame, *, by: list[str], value: str, amount: str, name: str, bins: int = 1024) -> DataFrame:
    """Adds the sum of ``amount`` over rows of smaller ``value`` in the same ``by``; values must be distinct there.

    Running sums over value ranges first, then inside each range, so no window
    holds more than the rows of one range.
    """
    span = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    met = same_keys(df, span, by)
    if by:
        # rows of one group meet their span in many tasks
        dealt = df.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
        met = same_keys(dealt, span.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*by, "__salt"]).drop("__salt")
    ranged = met.withColumn(
        "__bin", F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))).otherwise(0).cast("int")
    )
    sums = ranged.groupBy(*by, "__bin").agg(F.sum(amount).alias("__sum"))
    run = W.partitionBy(*by).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(run), F.lit(0.0))).drop("__sum")
    inside = W.partitionBy(*by, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = same_keys(ranged, sums, [*by, "__bin"])
    return joined.withColumn(name, F.col("__base") + F.coalesce(F.sum(amount).over(inside), F.lit(0.0))).drop("__lo", "__hi", "__bin", "__base")


def weighted_auc(df: DataFrame, *, score: str, label: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """``auc`` of each ``by``: weighted Mann-Whitney, ties count half; null if a class is empty."""
    by = by or []
    per = df.groupBy(*by, score).agg(F.sum(F.when(label, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(label, 0.0).otherwise(weight)).alias("neg"))
    ranked = with_before(per, by=by, value=score, amount="neg", name="below")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg")).alias("auc"))


def rates_at(df: DataFrame, *, score: str, label: Column, weight: Column, threshold: Column, by: list[str] | None = None) -> DataFrame:
    """Weighted true- and false-positive rates of ``score >= threshold``."""
    hit = F.col(score) >= threshold
    return df.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(F.when(label & hit, weight).otherwise(0.0)), F.sum(F.when(label, weight).otherwise(0.0))).alias("tpr"),
        F.try_divide(F.sum(F.when(~label & hit, weight).otherwise(0.0)), F.sum(F.when(~label, weight).otherwise(0.0))).alias("fpr"),
    )


def score_summary(df: DataFrame, *, score: str, label: Column, weight: Column, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """``n, tp, fp, tn, fn, precision, recall, average_precision, brier`` of scores in [0, 1], by group.

    Average precision adds up, over the distinct scores from the highest down, the precision
    there times the recall gained; rows of one score count together.  Counts are of rows,
    the last two are weighted.  Rows without score or label are left out; an undefined share is null.
    """
    by = by or []
    rows = df.select(*by, F.col(score).cast("double").alias("__s"), label.alias("__y"), weight.cast("double").alias("__w")).filter("__s is not null and __y is not null")
    hit, y, w = F.col("__s") >= threshold, F.col("__y"), F.col("__w")
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"),
        F.try_divide(F.sum(w * F.pow(F.col("__s") - y.cast("double"), 2)), F.sum(w)).alias("brier"),
    )
    per = materialize(rows.groupBy(*by, "__s").agg(F.sum(F.when(y, w).otherwise(0.0)).alias("pos"), F.sum(w).alias("all")))
    whole = per.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("all").alias("total"))
    below = with_before(with_before(per, by=by, value="__s", amount="pos", name="pos_below"), by=by, value="__s", amount="all", name="below")
    right = F.try_divide(F.col("all_pos") - F.col("pos_below"), F.col("total") - F.col("below"))
    area = same_keys(below, whole, by).groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * right), F.max("all_pos")).alias("average_precision"))
    out = same_keys(counts, area, by)
    out = out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.select(*by, "n", "tp", "fp", "tn", "fn", "precision", "recall", "average_precision", "brier")


def reliability(df: DataFrame, *, score: str, label: Column, weight: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """``bin, rows, said, right``: weighted mean score and share of the label in equal bins of [0, 1], and how far apart they are (``gap``)."""
    s = F.col(score).cast("double")
    at = F.least(F.lit(bins - 1), F.floor(s * bins)).cast("int")
    rows = df.filter(s.isNotNull() & label.isNotNull())
    out = rows.groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("rows"), F.try_divide(F.sum(weight * s), F.sum(weight)).alias("said"), F.try_divide(F.sum(F.when(label, weight).otherwise(0.0)), F.sum(weight)).alias("right"))
    return out.withColumn("gap", F.abs(F.col("said") - F.col("right")))


def _quantiles(counted: DataFrame, value: str, rows: str, probabilities: list[float]) -> list[float]:
    """Quantiles between neighbouring rows, from distinct values with their numbers of rows; only the values at those ranks are collected."""
    known = counted.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"), F.col(rows).alias("__rows"))
    total = known.agg(F.sum("__rows")).first()[0]
    if not total:
        return []
    places = [p * (total - 1) for p in probabilities]
    ranks = sorted({int(r) for p in places for r in (math.floor(p), math.ceil(p))})
    ranked = with_before(known, by=[], value="__v", amount="__rows", name="__before")
    at = F.exists(F.array(*[F.lit(float(r)) for r in ranks]), lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__rows")))
    found = ranked.filter(at).collect()  # two rows a probability at most
    held = {r: next(f["__v"] for f in found if f["__before"] <= r < f["__before"] + f["__rows"]) for r in ranks}
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(held[low] if held[low] == held[high] else (high - p) * held[low] + (p - low) * held[high])
    return out


def best_threshold(df: DataFrame, *, score: str, label: Column, weight: Column) -> DataFrame:
    """The threshold of highest ``tpr - fpr`` among the 49 unweighted quantiles .02 to .98; ties to the larger."""
    grid = [round(0.02 * i, 2) for i in range(1, 50)]
    per = materialize(df.groupBy(score).agg(F.sum(F.when(label, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(label, 0.0).otherwise(weight)).alias("neg"), F.count("*").alias("__n")))
    # 49 rows at most meet the rows of each distinct score
    cuts = df.sparkSession.createDataFrame([(t,) for t in sorted(set(_quantiles(per, score, "__n", grid)))], "threshold double")
    met = per.join(F.broadcast(cuts)).groupBy("threshold").agg(
        (F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("pos")).otherwise(0.0)) / F.sum("pos")).alias("tpr"),
        (F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("neg")).otherwise(0.0)) / F.sum("neg")).alias("fpr"),
    )
    best = F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), "threshold"))
    return met.agg(best.alias("b")).select("b.*")


def histograms(df: DataFrame, *, side: str, score: str, weight: str, bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """``(bin, agent, human, target)``: weight of each side in equal bins of [0, 1]."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int").alias("bin")
    sums = [F.sum(F.when(F.col(side) == s, F.col(weight)).otherwise(0.0)).alias(s) for s in ("agent", "human", "target")]
    return df.groupBy(*(by or []), at).agg(*sums)


def mixture_share(counts: DataFrame, *, bins: int = 20, steps: int = 200) -> DataFrame:
    """Most likely share of ``agent`` in the target histogram, class histograms smoothed by half a count.

    The likelihood is concave; a grid of ``steps`` and one ten times ``steps``
    finer around its best point give the share.  All frames have ``bins`` times
    grid rows at most.
    """
    spark = counts.sparkSession
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0.0, ["agent", "human", "target"])
    total = W.partitionBy()
    shaped = full.select(
        "target",
        ((F.col("agent") + 0.5) / (F.sum("agent").over(total) + 0.5 * bins)).alias("a"),
        ((F.col("human") + 0.5) / (F.sum("human").over(total) + 0.5 * bins)).alias("h"),
    )

    def best(grid: DataFrame) -> DataFrame:
        mixed = shaped.crossJoin(grid).withColumn("ll", F.col("target") * F.log(F.col("share") * F.col("a") + (1 - F.col("share")) * F.col("h")))
        per = mixed.groupBy("share").agg(F.round(F.sum("ll"), 9).alias("ll"))
        return per.agg(F.max_by("share", F.struct("ll", -F.col("share"))).alias("share"))

    coarse = best(spark.range(steps + 1).select((F.col("id") / steps).alias("share")))
    near = coarse.select(F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("i"), "share").select((F.col("share") + F.col("i") / (10.0 * steps)).alias("share"))
    return best(near.filter("share between 0 and 1"))


def kappa(df: DataFrame, *, first: str, second: str) -> DataFrame:
    """``agreement`` and Cohen's ``kappa`` (null if chance agreement is 1) from the table of answer pairs."""
    cells = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("chance"))
    both = n.join(F.broadcast(chance))
    expected = F.col("chance") / (F.col("total") * F.col("total"))
    agreement = F.col("same") / F.col("total")
    return both.select(F.col("total").alias("n"), agreement.alias("agreement"), F.when(expected < 1, (agreement - expected) / (1 - expected)).alias("kappa"))


def leave_one_out(df: DataFrame, *, group: str, hit: Column, weight: Column) -> DataFrame:
    """Weighted rate without each group, and its shift from the whole; from one pass of group sums."""
    per = df.groupBy(group).agg(F.sum(F.when(hit, weight).otherwise(0.0)).alias("h"), F.sum(weight).alias("w"))
    whole = per.agg(F.sum("h").alias("hh"), F.sum("w").alias("ww"))
    out = per.join(F.broadcast(whole))
    rate = F.try_divide(F.col("hh") - F.col("h"), F.col("ww") - F.col("w"))
    return out.select(group, rate.alias("rate"), (rate - F.try_divide("hh", "ww")).alias("shift"))


def envelope(df: DataFrame, *, by: list[str], share: str, contaminations: list[float]) -> DataFrame:
    """Least and largest share when a part ``c`` of either class is mislabelled: of ``c + (1 - c) q`` and ``(1 - c) q``."""
    each = df.withColumn("c", F.explode(F.array(*[F.lit(c) for c in contaminations])))
    up, down = F.col("c") + (1 - F.col("c")) * F.col(share), (1 - F.col("c")) * F.col(share)
    return each.groupBy(*by).agg(F.min(down).alias("low"), F.max(up).alias("high"))


def confusion(df: DataFrame, *, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    """``tp, fp, tn, fn, precision, recall``; the last two null where undefined."""
    count = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & ~actual).alias("tn"), count(~predicted & actual).alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def mixture_interval(df: DataFrame, draws: DataFrame, *, group: str, side: str, score: str, weight: str, bins: int = 20, steps: int = 100) -> DataFrame:
    """Percentile interval of the mixture share over whole-group resamples.

    Scores are counted by group, side and bin once; only these counts meet the
    draws.  The likelihood is searched on a grid of ``steps``.
    """
    spark = df.sparkSession
    per = histograms(df, side=side, score=score, weight=weight, bins=bins, by=[group])
    drawn = per.join(draws, group).groupBy("replicate", "bin").agg(*[F.sum(F.col(s) * F.col("copies")).alias(s) for s in ("agent", "human", "target")])
    cells = draws.select("replicate").distinct().crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    full = cells.join(drawn, ["replicate", "bin"], "left").fillna(0.0, ["agent", "human", "target"])
    total = W.partitionBy("replicate")
    shaped = full.select("replicate", "target", ((F.col("agent") + 0.5) / (F.sum("agent").over(total) + 0.5 * bins)).alias("a"), ((F.col("human") + 0.5) / (F.sum("human").over(total) + 0.5 * bins)).alias("h"))
    mixed = shaped.withColumn("share", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)))
    ll = mixed.groupBy("replicate", "share").agg(F.round(F.sum(F.col("target") * F.log(F.col("share") * F.col("a") + (1 - F.col("share")) * F.col("h"))), 9).alias("ll"))
    best = ll.groupBy("replicate").agg(F.max_by("share", F.struct("ll", -F.col("share"))).alias("share"))
    return best.agg(F.percentile("share", F.lit(0.025)).alias("low"), F.percentile("share", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def group_rates(df: DataFrame, *, by: list[str], hit: Column, weight: Column, least: float) -> DataFrame:
    """Weighted rate of each group of at least ``least`` weight; ``saturated`` where it is all or nothing."""
    out = df.groupBy(*by).agg(F.sum(weight).alias("weight"), F.sum(F.when(hit, weight).otherwise(0.0)).alias("hits")).filter(F.col("weight") >= least)
    rate = F.col("hits") / F.col("weight")
    return out.select(*by, "weight", rate.alias("rate"), ((rate == 0) | (rate == 1)).alias("saturated"))


def robust_scale(df: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """``scale``: the larger of the spread between the values at ``n/4`` and ``3n/4`` in order and the population deviation; 1 for fewer than two rows.

    Ranks come from a window by group, so no list of values is built.
    """
    run = W.partitionBy(*by)
    ranked = df.select(*by, F.col(value).alias("v")).withColumns({"i": F.row_number().over(run.orderBy("v")) - 1, "n": F.count("*").over(run)})
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q / 4), F.col("v")))
    out = ranked.groupBy(*by).agg(F.first("n").alias("n"), (at(3) - at(1)).alias("spread"), F.stddev_pop("v").alias("sd"))
    return out.select(*by, "n", F.when(F.col("n") < 2, 1.0).otherwise(F.greatest("spread", "sd", F.lit(1e-9))).alias("scale"))


def weighted_quantiles(df: DataFrame, *, value: str, weight: str, probabilities: list[float]) -> DataFrame:
    """``(probability, value)``: midpoint quantiles of weighted values, linear between them, flat outside.

    Rows of equal value and weight are counted first.  Of equal values the
    lighter row comes first.
    """
    per = df.groupBy(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("u")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    placed = with_before(per.groupBy("v").agg(F.sum("w").alias("w")), by=[], value="v", amount="w", name="base").select("v", "base")
    lighter = W.partitionBy("v").orderBy("u").rowsBetween(W.unboundedPreceding, -1)
    each = per.join(placed, "v").withColumn("before", F.col("base") + F.coalesce(F.sum("w").over(lighter), F.lit(0.0)))
    total = per.agg(F.sum("w").alias("total"))
    ends = F.array(F.col("before") + F.col("u") / 2, F.col("before") + F.col("w") - F.col("u") / 2)
    mid = each.join(F.broadcast(total)).select("v", F.explode(F.transform(ends, lambda x: x / F.col("total"))).alias("p"))
    # the neighbours of each probability: a few rows come out of one pass
    asked = df.sparkSession.createDataFrame([(float(q),) for q in probabilities], "probability double")
    near = asked.join(mid).groupBy("probability").agg(
        F.max(F.when(F.col("p") <= F.col("probability"), F.struct("p", "v"))).alias("lo"),
        F.min(F.when(F.col("p") > F.col("probability"), F.struct("p", "v"))).alias("hi"),
    )
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.try_divide(F.col("probability") - F.col("lo.p"), F.col("hi.p") - F.col("lo.p"))
    return near.select("probability", F.coalesce(between, F.col("lo.v"), F.col("hi.v")).alias("value"))


def cluster_bootstrap(df: DataFrame, draws: DataFrame, *, cluster: str, label: Column, score: str, weight: str) -> DataFrame:
    """Percentile interval of the difference of the weighted mean scores of the two labels.

    A drawn cluster brings all its rows, those of both labels; only sums by
    cluster meet the draws.
    """
    w, v = F.col(weight), F.col(weight) * F.col(score)
    on = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    per = df.groupBy(cluster).agg(on(label, w).alias("w1"), on(label, v).alias("v1"), on(~label, w).alias("w0"), on(~label, v).alias("v0"))
    each = per.join(draws, cluster).groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("copies")).alias(c) for c in ("w1", "v1", "w0", "v0")])
    gap = F.try_divide("v1", "w1") - F.try_divide("v0", "w0")
    return each.select(gap.alias("gap")).agg(F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"), F.count("gap").alias("replicates"))


def synthetic_recovery(df: DataFrame, *, group: str, side: str, score: str, weight: str, shares: list[float], trials: int, picks: int, seed: str, bins: int = 20, steps: int = 100) -> DataFrame:
    """``(share, error, worst)``: how well the mixture fit recovers known shares.

    For each share and trial, ``picks`` groups of each side are drawn with
    replacement by digest, no group for both sides in one trial, and their
    histograms are mixed in that share.  Scores are counted by group and bin
    once; only those counts meet the draws.
    """
    spark = df.sparkSession
    at = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    counts = df.groupBy(F.col(side).alias("side"), F.col(group).alias("g"), at.alias("bin")).agg(F.sum(weight).alias("w"))
    whole = counts.groupBy("bin").agg(F.sum(F.when(F.col("side") == "agent", F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("side") == "human", F.col("w")).otherwise(0.0)).alias("h"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(whole, "bin", "left").fillna(0.0)
    total = W.partitionBy()
    shaped = all_bins.select("bin", ((F.col("a") + 0.5) / (F.sum("a").over(total) + 0.5 * bins)).alias("a"), ((F.col("h") + 0.5) / (F.sum("h").over(total) + 0.5 * bins)).alias("h"))

    digest = lambda *p: F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(seed), *[x.cast("string") for x in p]).cast("binary"), 256), 1, 12), 16, 10).cast("long")
    # half of the groups, by digest, can be drawn for a side in a trial, the other half for the other one
    runs = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(F.lit("agent"), F.lit("human"))).alias("side"))
    groups = counts.select("side", "g").distinct().join(runs, "side").filter((digest(F.lit("half"), F.col("trial"), F.col("g")) % 2 == 0) == (F.col("side") == "agent"))
    ranked = groups.withColumn("place", F.row_number().over(W.partitionBy("trial", "side").orderBy("g")) - 1).withColumn("n", F.count("*").over(W.partitionBy("trial", "side")))
    drawn = runs.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(picks - 1)))).withColumn("d", digest(F.lit("pick"), F.col("trial"), F.col("side"), F.col("pick")))
    sizes = ranked.select("trial", "side", "n").distinct()
    chosen = drawn.join(sizes, ["trial", "side"]).withColumn("place", F.col("d") % F.col("n")).join(ranked.drop("n"), ["trial", "side", "place"]).groupBy("trial", "side", "g").agg(F.count("*").alias("copies"))
    mixed = chosen.join(counts, ["side", "g"]).groupBy("trial", "side", "bin").agg(F.sum(F.col("w") * F.col("copies")).alias("w"))
    mixed = mixed.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("trial", "side")))
    target = mixed.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    target = target.groupBy("trial", "share", "bin").agg(F.sum(F.when(F.col("side") == "agent", F.col("share")).otherwise(1 - F.col("share")) * F.col("w")).alias("t"))
    grid = target.join(shaped, "bin").withColumn("q", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)))
    ll = grid.groupBy("trial", "share", "q").agg(F.round(F.sum(F.col("t") * F.log(F.col("q") * F.col("a") + (1 - F.col("q")) * F.col("h"))), 9).alias("ll"))
    fit = ll.groupBy("trial", "share").agg(F.max_by("q", F.struct("ll", -F.col("q"))).alias("q"))
    error = F.abs(F.col("q") - F.col("share"))
    return fit.groupBy("share").agg(F.avg(error).alias("error"), F.max(error).alias("worst"), F.count("*").alias("trials"))
