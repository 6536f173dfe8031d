"""Survival and state occupancy of weighted histories, with clustered bootstrap.

Every estimator first adds up weights by time, so what the windows see is one
row for each distinct time (and stratum, and replicate), not for each history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators.quantify import same_keys, with_before
from sedimenta.plans.scratch import materialize


def balanced_weights(df: DataFrame, *, cluster: list[str], copies: Column | None = None) -> DataFrame:
    """Adds ``weight``: copies of the cluster over its rows, so that every cluster weighs alike."""
    n = F.count("*").over(W.partitionBy(*cluster))
    return df.withColumn("weight", (F.lit(1.0) if copies is None else copies.cast("double")) / n)


def kaplan_meier(df: DataFrame, *, time: str, event: Column, weight: str, horizons: list[int], by: list[str] | None = None) -> DataFrame:
    """``survival, risk_weight, risk_rows`` at each horizon.

    Rows that end at ``t`` are at risk at ``t``; events of one time count
    together; a horizon has the events up to and including it, and at risk are
    the rows that end at it or later.
    """
    by = by or []
    ends = df.groupBy(*by, time).agg(F.sum(weight).alias("ended"), F.sum(F.when(event, F.col(weight)).otherwise(0.0)).alias("died"), F.count("*").alias("rows"))
    tail = W.partitionBy(*by).orderBy(F.col(time).desc())
    run = W.partitionBy(*by).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    curve = ends.withColumn("risk", F.sum("ended").over(tail.rowsBetween(W.unboundedPreceding, 0))).withColumn("survival", F.product(1 - F.col("died") / F.col("risk")).over(run))
    points = curve.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    upto = F.col(time) <= F.col("horizon")
    return points.groupBy(*by, "horizon").agg(
        F.coalesce(F.max_by(F.when(upto, F.col("survival")), F.when(upto, F.col(time))), F.lit(1.0)).alias("survival"),
        F.sum(F.when(F.col(time) >= F.col("horizon"), F.col("ended")).otherwise(0.0)).alias("risk_weight"),
        F.sum(F.when(F.col(time) >= F.col("horizon"), F.col("rows")).otherwise(0)).alias("risk_rows"),
    )


#: Moves between states: from unchanged or modified to modified, deleted or out of sight.
_KINDS = ("um", "ud", "md", "uc", "mc")


def _moves(df: DataFrame, *, by: list[str], modified: str, deleted: str, censored: str, weight: str) -> DataFrame:
    """Weight of each kind of move at each distinct time."""
    m, d = F.col(modified), F.col(deleted)
    m = F.when(d.isNull() | (m < d), m)
    end = F.coalesce(d, F.col(censored))
    w = F.col(weight)
    moves = F.array(
        F.when(m.isNotNull(), F.struct(m.cast("double").alias("t"), F.lit("um").alias("kind"))),
        F.struct(end.cast("double").alias("t"), F.when(d.isNotNull(), F.when(m.isNotNull(), "md").otherwise("ud")).otherwise(F.when(m.isNotNull(), "mc").otherwise("uc")).alias("kind")),
    )
    each = df.select(*by, w.alias("w"), F.explode(F.array_compact(moves)).alias("x"))
    return each.groupBy(*by, F.col("x.t").alias("t")).agg(*[F.sum(F.when(F.col("x.kind") == k, F.col("w")).otherwise(0.0)).alias(k) for k in _KINDS])


def occupancy(df: DataFrame, *, modified: str, deleted: str, censored: str, weight: str, horizons: list[int], by: list[str] | None = None) -> DataFrame:
    """Aalen-Johansen shares of unchanged, modified and deleted rows at each horizon.

    A row has a modification time, a deletion time (either may be null) and a
    censoring time, its end if it is not deleted.  A deletion at the time of the
    modification counts as deletion from unchanged.  Rows censored before ``t``
    have left when ``t`` comes, those censored at ``t`` have not.
    """
    by = by or []
    per = _moves(df, by=by, modified=modified, deleted=deleted, censored=censored, weight=weight)
    return _occupied(per, by=by, horizons=horizons, everyone=df.select(*by).distinct() if by else None)


#: Ranges of time whose steps are multiplied on their own.
RANGES = 64


def _product(steps: Column) -> Column:
    """The product of 2x2 upper triangular matrices ``[[u, a], [0, m]]`` in the order of the list."""
    one = F.struct(F.lit(1.0).alias("u"), F.lit(0.0).alias("a"), F.lit(1.0).alias("m"))
    return F.aggregate(steps, one, lambda p, x: F.struct((p["u"] * x["u"]).alias("u"), (p["u"] * x["a"] + p["a"] * x["m"]).alias("a"), (p["m"] * x["m"]).alias("m")))


def _occupied(per: DataFrame, *, by: list[str], horizons: list[int], everyone: DataFrame | None) -> DataFrame:
    """Shares at each horizon from the weights of moves at each distinct time ``t``: um, ud, md, uc, mc.

    A time's step is a matrix over (unchanged, modified); what is left of the row is
    deleted.  Steps are multiplied within ranges of time that end at horizons, then the
    products of the ranges up to each horizon; no list holds more than a range or one entry a range.
    """
    per = materialize(per)  # one row a time, read several times below
    left_u = with_before(per.withColumn("leaves", F.col("um") + F.col("ud") + F.col("uc")), by=by, value="t", amount="leaves", name="gone_u")
    left_u = materialize(left_u)
    both = with_before(left_u.withColumn("enters", F.col("um") - F.col("md") - F.col("mc")), by=by, value="t", amount="enters", name="ym")
    at_risk = same_keys(both, per.groupBy(*by).agg(F.sum(F.col("um") + F.col("ud") + F.col("uc")).alias("all_u"), F.min("t").alias("from_t"), F.max("t").alias("to_t")), by)
    tiny, yu = F.lit(1e-12), F.col("all_u") - F.col("gone_u")
    a, b = (F.when(yu > tiny, F.col(c) / yu).otherwise(0.0) for c in ("um", "ud"))
    c = F.when(F.col("ym") > tiny, F.least(F.lit(1.0), F.col("md") / F.col("ym"))).otherwise(0.0)
    part = sum((F.when(F.col("t") > h, 1).otherwise(0) for h in horizons), F.lit(0))
    inside = F.least(F.lit(RANGES - 1), F.floor((F.col("t") - F.col("from_t")) / F.greatest(F.col("to_t") - F.col("from_t"), F.lit(1e-9)) * RANGES))
    steps = at_risk.select(*by, "t", part.alias("part"), inside.alias("range"), (1 - a - b).alias("u"), a.alias("a"), (1 - c).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("t", "u", "a", "m")))
    ranges = steps.groupBy(*by, "part", "range").agg(_product(ordered).alias("p"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "range", "p.u", "p.a", "p.m")))
    listed = ranges.groupBy(*by).agg(ordered.alias("ranges"))
    if everyone is not None:
        listed = everyone.join(listed.withColumnsRenamed({k: f"__{k}" for k in by}), _all_same(by), "left").drop(*[f"__{k}" for k in by])
    else:
        listed = per.sparkSession.range(1).select().join(listed, F.lit(True), "left")
    limits = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(sum(h > g for g in horizons)).alias("most")) for h in horizons])
    points = listed.select(*by, "ranges", F.explode(limits).alias("h"))
    upto = F.filter(F.coalesce("ranges", F.array().cast("array<struct<part:int,range:bigint,u:double,a:double,m:double>>")), lambda x: x["part"] <= F.col("h.most"))
    done = points.select(*by, "h.horizon", _product(upto).alias("p"))
    return done.select(*by, "horizon", F.col("p.u").alias("unchanged"), F.col("p.a").alias("modified"), F.greatest(F.lit(0.0), 1 - F.col("p.u") - F.col("p.a")).alias("deleted"))


def _all_same(by: list[str]) -> Column:
    hit = F.lit(True)
    for k in by:
        hit = hit & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return hit


def bootstrap_occupancy(df: DataFrame, draws: DataFrame, *, cluster: str, modified: str, deleted: str, censored: str, weight: str, horizons: list[int]) -> DataFrame:
    """``horizon, state, low, high, replicates``: percentile intervals of the shares of :func:`occupancy` over whole-cluster resamples.

    Moves are added up by cluster and time; only these sums meet the draws.
    """
    sums = _moves(df, by=[cluster], modified=modified, deleted=deleted, censored=censored, weight=weight)
    drawn = sums.join(draws, cluster).groupBy("replicate", "t").agg(*[F.sum(F.col(k) * F.col("copies")).alias(k) for k in _KINDS])
    each = _occupied(drawn, by=["replicate"], horizons=horizons, everyone=draws.select("replicate").distinct())
    long = each.unpivot(["replicate", "horizon"], ["unchanged", "modified", "deleted"], "state", "share")
    ends = [F.percentile("share", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]
    return long.groupBy("horizon", "state").agg(*ends, F.count("*").alias("replicates"))


def cluster_draws(clusters: DataFrame, *, cluster: str, replicates: int = 2000, seed: str) -> DataFrame:
    """``(replicate, cluster, copies)``: whole-cluster resamples, as many draws as clusters.

    Draw ``j`` of replicate ``b`` takes the cluster whose place in sorted order
    is the head of ``sha256(seed NUL b NUL j)`` modulo their number.  The window
    runs over one row a cluster.
    """
    ranked = clusters.select(cluster).distinct().withColumn("place", F.row_number().over(W.orderBy(cluster)) - 1)
    n = ranked.agg(F.count("*").alias("n"))
    draws = ranked.select(F.col("place").alias("j")).join(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col("replicate").cast("string"), F.lit("\0"), F.col("j").cast("string")).cast("binary"), 256)
    place = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")).alias("place")
    return draws.select("replicate", place).groupBy("replicate", "place").agg(F.count("*").alias("copies")).join(ranked, "place").select("replicate", cluster, "copies")


def bootstrap_survival(df: DataFrame, draws: DataFrame, *, cluster: str, time: str, event: Column, weight: str, horizons: list[int]) -> DataFrame:
    """Percentile interval (2.5, 97.5, linear) of survival at each horizon over the replicates.

    Weights are first added up by time and cluster; only these sums are joined
    with the draws.
    """
    sums = df.groupBy(cluster, time).agg(F.sum(weight).alias("w"), F.sum(F.when(event, F.col(weight)).otherwise(0.0)).alias("dw"))
    drawn = sums.join(draws, cluster).select("replicate", time, (F.col("w") * F.col("copies")).alias("w"), (F.col("dw") * F.col("copies")).alias("dw"))
    per = drawn.groupBy("replicate", time).agg(F.sum("w").alias("ended"), F.sum("dw").alias("died"))
    tail = W.partitionBy("replicate").orderBy(F.col(time).desc()).rowsBetween(W.unboundedPreceding, 0)
    run = W.partitionBy("replicate").orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    curve = per.withColumn("risk", F.sum("ended").over(tail)).withColumn("survival", F.product(1 - F.col("died") / F.col("risk")).over(run))
    points = curve.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).filter(F.col(time) <= F.col("horizon"))
    each = points.groupBy("replicate", "horizon").agg(F.max_by("survival", time).alias("survival"))
    return each.groupBy("horizon").agg(F.percentile("survival", F.lit(0.025)).alias("low"), F.percentile("survival", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def complete_case(df: DataFrame, *, cluster: list[str], by: list[str], state: str, survived: list[str], observable: list[str]) -> DataFrame:
    """Shares that survive among observable rows: pooled, and the mean of the clusters' own; null where none is observable."""
    seen = F.sum(F.when(F.col(state).isin(*observable), 1).otherwise(0))
    alive = F.sum(F.when(F.col(state).isin(*survived), 1).otherwise(0))
    per = df.groupBy(*by, *[c for c in cluster if c not in by]).agg(seen.alias("seen"), alive.alias("alive"), F.count("*").alias("rows"))
    return per.groupBy(*by).agg(
        F.avg(F.try_divide("alive", "seen")).alias("balanced"),
        F.try_divide(F.sum("alive"), F.sum("seen")).alias("pooled"),
        F.try_divide(F.sum("seen"), F.sum("rows")).alias("coverage"),
        F.count("*").alias("clusters"),
    )


def history(snapshots: DataFrame, *, key: str, horizon: str, state: str, deleted_at: str, modified_at: str, lost_at: str, cutoff: Column) -> DataFrame:
    """Event history from horizon snapshots: times of modification and deletion, censoring time and its reason.

    A modification at the time of the deletion is dropped; without deletion a
    row is censored when it was lost, else at the cutoff, else at its last
    observed horizon.
    """
    per = snapshots.groupBy(key).agg(
        F.min(deleted_at).alias("deleted"),
        F.min(modified_at).alias("modified"),
        F.min(lost_at).alias("lost"),
        F.min(cutoff).alias("cutoff"),
        F.max(F.when(F.col(state).isin("unchanged", "modified"), F.col(horizon))).alias("last_seen"),
    )
    gone = F.col("deleted").isNotNull()
    return per.select(
        key,
        F.when(~gone | (F.col("modified") < F.col("deleted")), F.col("modified")).alias("modified"),
        "deleted",
        F.when(gone, F.col("deleted")).otherwise(F.coalesce("lost", F.least("cutoff", F.coalesce("last_seen", "cutoff")))).alias("censored"),
        F.when(gone, "deleted").when(F.col("lost").isNotNull(), "lost").otherwise("cutoff").alias("reason"),
    )


def stratum_shares(counts: DataFrame, draws: DataFrame, *, stratum: str, cluster: str, good: str, seen: str, rows: str, least_clusters: int = 5, least_coverage: float = 0.8) -> DataFrame:
    """Survival shares of each stratum with whole-cluster intervals, the intervals null with reasons where a gate fails.

    ``counts`` has one row a stratum and cluster.  Balanced is the mean of the
    clusters' own shares (those that observe nothing are skipped), pooled the share
    of all rows.  Draws are of the clusters of all strata; a stratum uses those of
    its own.
    """
    own = F.try_divide(good, seen)

    def shares(copies: Column) -> list[Column]:
        balanced = F.try_divide(F.sum(own * copies), F.sum(F.when(own.isNotNull(), copies)))
        return [balanced.alias("balanced"), F.try_divide(F.sum(F.col(good) * copies), F.sum(F.col(seen) * copies)).alias("pooled")]

    point = counts.groupBy(stratum).agg(*shares(F.lit(1)), F.count("*").alias("clusters"), F.try_divide(F.sum(seen), F.sum(rows)).alias("coverage"))
    each = counts.join(draws, cluster).groupBy(stratum, "replicate").agg(*shares(F.col("copies")))
    ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("balanced", "pooled") for n, q in (("low", 0.025), ("high", 0.975))]
    spread = each.groupBy(stratum).agg(*ends)
    few = F.when(F.col("clusters") < least_clusters, f"fewer_than_{least_clusters}_clusters")
    thin = F.when(~F.coalesce(F.col("coverage") >= least_coverage, F.lit(False)), f"coverage_below_{least_coverage:.2f}")
    out = point.join(spread, stratum, "left").withColumn("reasons", F.array_compact(F.array(few, thin)))
    ok = F.size("reasons") == 0
    names = [f"{c}_{n}" for c in ("balanced", "pooled") for n in ("low", "high")]
    return out.select(stratum, "clusters", "coverage", "balanced", "pooled", *[F.when(ok, F.col(c)).alias(c) for c in names], "reasons")
