"""Joins of evidence: one-to-one, with fallbacks, with pending rows, and unions that may conflict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, *, key: str, at: str) -> DataFrame:
    """Both sides joined on ``key``; ``problem`` tells where a side is missing or their ``at`` differs, else null."""
    b = right.withColumnRenamed(at, "__at").withColumn("__right", F.lit(True))
    both = left.withColumn("__left", F.lit(True)).join(b, key, "full_outer")
    problem = F.when(F.col("__left").isNull(), "missing_left").when(F.col("__right").isNull(), "missing_right").when(~F.col(at).eqNullSafe(F.col("__at")), "time_differs")
    return both.withColumn("problem", problem).drop("__at", "__left", "__right")


def with_pending(results: DataFrame, enrichments: DataFrame, *, on: list[str], status: str) -> DataFrame:
    """Every result with its enrichment, ``pending`` where there is none."""
    return results.join(enrichments, on, "left").withColumn(status, F.coalesce(status, F.lit("pending")))


def unused(results: DataFrame, enrichments: DataFrame, *, on: list[str]) -> DataFrame:
    """Enrichments that no result asks for."""
    return enrichments.join(results.select(*on).distinct(), on, "left_anti")


def expanded(groups: DataFrame, *, members: str, member: str) -> DataFrame:
    """The attribution of each group for every one of its members."""
    return groups.withColumn(member, F.explode(members)).drop(members)


def fallback_match(rows: DataFrame, observations: DataFrame, *, path: str, exact: str, value: str) -> DataFrame:
    """For each row the observation at its path of the same ``exact`` if it is the only one, else the only one at the path.

    Adds ``value`` and ``basis``: exact, path or missing.  Observations are
    counted by key first, so a row meets one row a key.
    """
    by_exact = observations.groupBy(path, exact).agg(F.count("*").alias("__n"), F.first(value).alias("__v"))
    by_path = observations.groupBy(path).agg(F.count("*").alias("__pn"), F.first(value).alias("__pv"))
    joined = rows.join(by_exact, [path, exact], "left").join(by_path, path, "left")
    found = F.when(F.col("__n") == 1, F.col("__v")).when(F.col("__pn") == 1, F.col("__pv"))
    basis = F.when(F.col("__n") == 1, "exact").when(F.col("__pn") == 1, "path").otherwise("missing")
    return joined.withColumn(value, found).withColumn("basis", basis).drop("__n", "__v", "__pn", "__pv")


def kept_lines(transitions: DataFrame, keys: DataFrame, *, on: list[str], line: str, horizons: int) -> DataFrame:
    """Transitions of the matched keys, and for each key whether it has ``horizons`` rows for every line."""
    kept = transitions.join(keys.select(*on).distinct(), on, "left_semi")
    counts = kept.groupBy(*on).agg(F.count("*").alias("rows"), F.count_distinct(line).alias("lines"))
    return counts.withColumn("complete", F.col("rows") == horizons * F.col("lines"))


def memberships(frames: dict[str, DataFrame], *, key: str, snapshot: str) -> DataFrame:
    """Union of named frames by key: the frames that hold it, its snapshot, and whether frames disagree on that."""
    each = [df.select(key, F.lit(name).alias("frame"), F.col(snapshot).alias("snapshot")) for name, df in frames.items()]
    rows = reduce(DataFrame.unionByName, each)
    out = rows.groupBy(key).agg(F.sort_array(F.collect_set("frame")).alias("frames"), F.min("snapshot").alias("lo"), F.max("snapshot").alias("hi"))
    conflict = F.col("lo") < F.col("hi")
    return out.select(key, "frames", F.when(~conflict, F.col("lo")).alias("snapshot"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def effective_units(base: DataFrame, recovered: DataFrame, *, key: str, valid: Column, value: str) -> DataFrame:
    """Base units where valid, else what recovered them; ``problem`` for a missing or an orphan recovery."""
    r = recovered.select(key, F.col(value).alias("__r"), F.lit(True).alias("__has"))
    both = base.withColumn("__base", F.lit(True)).withColumn("__valid", valid).join(r, key, "full_outer")
    problem = (
        F.when(F.col("__base").isNull(), "orphan")
        .when(F.col("__valid") & F.col("__has"), "recovered_though_valid")
        .when(~F.col("__valid") & F.col("__has").isNull(), "missing_recovery")
    )
    return both.select(key, F.when(F.col("__valid"), F.col(value)).otherwise(F.col("__r")).alias(value), F.when(F.col("__valid"), "base").otherwise("recovery").alias("basis"), problem.alias("problem"))


def linked_candidates(records: DataFrame, candidates: DataFrame, *, key: str, candidate: str) -> DataFrame:
    """Records with the sorted distinct ids of their candidates, an empty list where there is none."""
    ids = candidates.groupBy(key).agg(F.sort_array(F.collect_set(candidate)).alias("candidates"))
    kind = ids.schema["candidates"].dataType
    return records.join(ids, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(kind)))


def class_rates(public: DataFrame, private: DataFrame, *, key: str, answer: str, truth: str) -> DataFrame:
    """Cases, right ones and precision by answer; cases that only one side holds are an own class, ``unpaired``."""
    both = public.withColumn("__a", F.lit(1)).join(private.withColumn("__b", F.lit(1)), key, "full_outer")
    paired = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = both.groupBy(F.when(paired, F.col(answer)).otherwise("unpaired").alias(answer)).agg(F.count("*").alias("cases"), F.count_if(paired & (F.col(answer) == F.col(truth))).alias("right"))
    return out.withColumn("precision", F.when(F.col(answer) != "unpaired", F.col("right") / F.col("cases")))


def reachable(frame: DataFrame, facts: DataFrame, *, unit: str, item: str, lines: str, ok: Column, least: int) -> DataFrame:
    """Units of the frame over the items that facts show as landed, summed again and held to the least size again."""
    landed = facts.filter(ok).select(unit, item).distinct()
    return frame.join(landed, [unit, item]).groupBy(unit).agg(F.count_distinct(item).alias("items"), F.sum(lines).alias("lines")).filter(F.col("lines") >= least)


def reasons_by_unit(requested: DataFrame, observed: DataFrame, *, unit: str, item: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """Each unit's requested items by the first rule they fail: ``missing`` if not observed, ``eligible`` if none."""
    joined = requested.select(unit, item).distinct().join(observed.withColumn("__seen", F.lit(True)), [unit, item], "left")
    reason = F.when(F.col("__seen").isNull(), "missing")
    for rule, name in rules:
        reason = reason.when(rule, name)
    return joined.groupBy(unit, reason.otherwise("eligible").alias("reason")).agg(F.count("*").alias("n"), F.min(item).alias("first"))


def bundles(packets: DataFrame, *, key: str, item: str, same: list[str], family: str) -> DataFrame:
    """Packets by event: how many, their families, and whether their metadata agree."""
    out = packets.groupBy(key).agg(F.count_distinct(item).alias("packets"), F.sort_array(F.collect_set(family)).alias("families"), F.count_distinct(F.struct(*same)).alias("versions"))
    return out.withColumn("consistent", F.col("versions") == 1).drop("versions")


def pending_groups(records: DataFrame, *, keys: list[str], line: str) -> DataFrame:
    """Pending lines by key as one sorted list, counted from 1, with an id from the content of the group."""
    grouped = records.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(line) + 1)).alias("lines"))
    content = F.concat_ws("\0", *[F.col(k).cast("string") for k in keys], F.array_join(F.col("lines").cast("array<string>"), ","))
    return grouped.withColumn("group_id", F.sha2(content.cast("binary"), 256))


def overlaps(children: DataFrame, *, parent: str, child: str, result: str) -> DataFrame:
    """Results of each parent over all its children: rows, distinct ones, and those that several children return."""
    per = children.groupBy(parent, result).agg(F.count("*").alias("n"), F.count_distinct(child).alias("children"))
    return per.groupBy(parent).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"), F.count_if(F.col("children") > 1).alias("shared"))


def frame_coverage(frames: DataFrame, included: DataFrame, *, frame: str, key: str) -> DataFrame:
    """Expected and included ids of every frame."""
    marked = frames.select(frame, key).distinct().join(included.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    return marked.groupBy(frame).agg(F.count("*").alias("expected"), F.count("__in").alias("included"))


def landings(commits: DataFrame, ancestry: DataFrame, *, repository: str, commit: str, position: str) -> DataFrame:
    """Earliest first-parent commit that contains each commit; null where none does."""
    first = ancestry.groupBy(repository, commit).agg(F.min_by("container", position).alias("landing"), F.min(position).alias(position))
    return commits.select(repository, commit).join(first, [repository, commit], "left")


def candidate_sequence(events: DataFrame, *, by: str, order: list[str], anchor: Column) -> DataFrame:
    """Events of each unit up to its earliest anchor, numbered in order; units without an anchor have none."""
    at = F.struct(*order)
    first = events.filter(anchor).groupBy(by).agg(F.min(at).alias("__anchor"))
    upto = events.join(first, by).filter(at <= F.col("__anchor"))
    return upto.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(*order))).drop("__anchor")


def ledger(entries: DataFrame, tranche: DataFrame, *, key: str, number: int) -> DataFrame:
    """A decision ledger with one more tranche appended; a key decided before is kept as it was, and the new row told as ``rejected``."""
    new = tranche.withColumn("tranche", F.lit(number))
    again = new.join(entries.select(key).distinct(), key, "left_semi").withColumn("rejected", F.lit(True))
    added = new.join(entries.select(key).distinct(), key, "left_anti").withColumn("rejected", F.lit(False))
    return entries.withColumn("rejected", F.lit(False)).unionByName(added).unionByName(again)
