"""Greedy one-to-one matching inside blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def caliper_pairs(targets: DataFrame, candidates: DataFrame, *, block: list[str], at: str, size: str, days: float, ratio: float) -> DataFrame:
    """Pairs of a block within ``days`` of each other and within a factor ``ratio`` in size.

    Both sides are dealt to bands of ``days``; a target meets the candidates of
    its own and the two next bands, so the join is an equality.
    """
    band = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(days * 86400e6))
    t = targets.withColumn("__band", F.explode(F.array(*[band(F.col(at)) + i for i in (-1, 0, 1)]))).alias("t")
    c = candidates.withColumn("__band", band(F.col(at))).alias("c")
    on = F.col("t.__band") == F.col("c.__band")
    for b in block:
        on = on & (F.col(f"t.{b}") == F.col(f"c.{b}"))
    gap = F.abs(F.unix_micros(F.col(f"t.{at}").cast("timestamp")) - F.unix_micros(F.col(f"c.{at}").cast("timestamp"))) / F.lit(86400e6)
    larger = F.greatest(F.col(f"t.{size}"), F.col(f"c.{size}"))
    smaller = F.least(F.col(f"t.{size}"), F.col(f"c.{size}"))
    near = (gap <= days) & (smaller > 0) & (larger <= ratio * smaller)
    return t.join(c, on & near).select(*[F.col(f"t.{b}").alias(b) for b in block], F.struct("t.*").alias("target"), F.struct("c.*").alias("candidate"), gap.alias("gap"), (larger / smaller).alias("size_ratio"))


def greedy(pairs: DataFrame, *, block: list[str], target: Column, candidate: Column, order: Column, cost: list[Column], packs: int = 256) -> DataFrame:
    """``(block, target, candidate)``: targets in ``order`` each take their cheapest free candidate, ties to the smaller id.

    The choice is sequential inside a block; blocks are independent, and about as
    many as fit are dealt to each of ``packs`` tasks by hash.
    """
    costs = [f"__c{i}" for i in range(len(cost))]
    flat = pairs.select(*block, target.cast("string").alias("target"), candidate.cast("string").alias("candidate"), order.alias("__order"), *[c.cast("double").alias(n) for c, n in zip(cost, costs, strict=True)])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in flat.schema if f.name in block], "target string", "candidate string"])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*block, "__order", "target", *costs, "candidate"])
        keys, targets, candidates = list(zip(*[frame[b] for b in block], strict=True)), frame["target"].tolist(), frame["candidate"].tolist()
        taken: set[str] = set()
        out, place, served = [], None, None
        for key, mine, free in zip(keys, targets, candidates, strict=True):
            if key != place:
                taken, place, served = set(), key, None
            if mine != served and free not in taken:
                taken.add(free)
                served = mine
                out.append([*key, mine, free])
        return pd.DataFrame(out, columns=[*block, "target", "candidate"])

    return flat.groupBy(F.pmod(F.xxhash64(*block), F.lit(packs))).applyInPandas(choose, schema)


def _alike(column: np.ndarray, value: object) -> np.ndarray:
    """Where ``column`` equals ``value``; null equals nothing."""
    return np.zeros(len(column), bool) if value is None else (column == value).astype(bool)


def greedy_nearest(
    targets: DataFrame,
    candidates: DataFrame,
    *,
    block: list[str],
    unit: str,
    numbers: dict[str, float],
    labels: list[str],
    tier: str | None = None,
    caliper: float | None = None,
    packs: int = 256,
) -> DataFrame:
    """``(target, candidate, basis, distance)``: targets in order of their ids take the nearest free candidate of their block.

    The distance is the root of the squared differences of ``numbers``, each divided
    by its scale, and 1 for every label that differs; ties go to the smaller digest
    of the candidate's id.  With ``tier``, candidates of an equal tier come first and
    others only if none of these is free.  A target without candidates has
    basis ``no_overlap``; beyond the caliper it has ``outside_caliper``, the distance
    found, and takes nothing.  The choice is sequential inside a block; blocks are
    independent and a task holds the narrow rows of its own.
    """
    used = [*block, unit, *numbers, *labels, *([tier] if tier else [])]
    used = list(dict.fromkeys(used))
    sides = [df.select(*used, F.sha2(F.col(unit).cast("string").cast("binary"), 256).alias("__digest"), F.pmod(F.xxhash64(*block), F.lit(packs)).alias("__pack")) for df in (targets, candidates)]
    kind = targets.schema[unit].dataType.simpleString()
    # both sides may come of one frame: other names keep their columns apart
    sides[1] = sides[1].toDF(*[f"__c_{c}" for c in sides[1].columns])

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right.columns = left.columns
        pools = {k: g.sort_values("__digest") for k, g in right.groupby(block)}
        compared = [*labels, *([tier] if tier else [])]
        for key, own in left.groupby(block):
            pool = pools.get(key)
            free = np.ones(0 if pool is None else len(pool), bool)
            # the columns of a block are taken out once; a target meets arrays
            held = {} if pool is None else {c: pool[c].to_numpy(float) if c in numbers else pool[c].astype(object).to_numpy() for c in [*numbers, *compared]}
            names = None if pool is None else pool[unit].tolist()
            own = own.sort_values(unit)
            rows = zip(own[unit].tolist(), zip(*[own[c].tolist() for c in [*numbers, *compared]], strict=True), strict=True)
            for mine, values in rows:
                if not free.any():
                    out.append((mine, None, "no_overlap", None))
                    continue
                row = dict(zip([*numbers, *compared], values, strict=True))
                ok, basis = free, "same_block"
                if tier:
                    same = free & _alike(held[tier], row[tier])
                    ok, basis = (same, "same_tier") if same.any() else (free, "same_block")
                d = sum(((held[c] - row[c]) / s) ** 2 for c, s in numbers.items()) + sum((~_alike(held[c], row[c])).astype(float) for c in labels)
                d = np.where(ok, np.sqrt(d), np.inf)
                at = int(d.argmin())
                if caliper is not None and d[at] > caliper:
                    out.append((mine, None, "outside_caliper", float(d[at])))
                    continue
                free[at] = False
                out.append((mine, names[at], basis, float(d[at])))
        return pd.DataFrame(out, columns=["target", "candidate", "basis", "distance"]).astype({"candidate": "Int64"} if kind in ("bigint", "int") else {})

    return sides[0].groupBy("__pack").cogroup(sides[1].groupBy("__c___pack")).applyInPandas(choose, f"target {kind}, candidate {kind}, basis string, distance double")
