"""Joins, dedupes, contamination rules and aggregations over cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candidate_units(rows: DataFrame, *, keys: list[str], item: str, additions: str, at: str, least: int) -> DataFrame:
    """Two levels: items (such as pull requests) inside units, then units of at least ``least`` added lines.

    Negative and null additions count as 0; rows are summed as they come, as one
    item may stand on several.  A unit lists its items in order with their sums.
    """
    added = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(additions).cast("long"), F.lit(0).cast("long")))
    items = rows.groupBy(*keys, item).agg(F.sum(added).alias("item_lines"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    units = items.groupBy(*keys).agg(
        F.sum("item_lines").alias("lines"),
        F.count("*").alias("items"),
        F.min("lo").alias("first_at"),
        F.max("hi").alias("last_at"),
        F.sort_array(F.collect_list(F.struct(F.col(item).alias("item"), F.col("item_lines").alias("lines")))).alias("by_item"),
    )
    return units.filter(F.col("lines") >= least)


def grouping_cells(rows: DataFrame, cells: DataFrame, *, sets: list[list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """Grouping sets over ``rows``, one row for each cell of ``cells`` even if empty.

    ``cells`` has the union of the set columns (null where a set lacks one) and
    ``set_id``, the position of the set.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    parts = []
    for i, s in enumerate(sets):
        part = rows.groupBy(*s).agg(*[a.alias(n) for n, a in aggregates.items()])
        parts.append(part.select(F.lit(i).alias("set_id"), *[F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], *aggregates))
    found = reduce(DataFrame.unionByName, parts)
    on = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ["set_id", *columns]])
    return cells.alias("c").join(found.alias("f"), on, "left").select("c.set_id", *[f"c.{c}" for c in columns], *[f"f.{n}" for n in aggregates])


def separate_roles(df: DataFrame, *, partition: str, group: str, content: str, target: str) -> DataFrame:
    """Adds ``dropped``: why a labelled row may not be used, null if it may.

    Content that the target partition holds goes from all other partitions;
    content in more than one labelled group goes from all of them; repeats
    inside one group stay.
    """
    labelled = F.col(partition) != target
    per = df.groupBy(content).agg(
        F.max((~labelled).cast("int")).alias("__in_target"),
        F.min(F.when(labelled, F.col(group))).alias("__lo"),
        F.max(F.when(labelled, F.col(group))).alias("__hi"),
    )
    reason = F.when(~labelled, F.lit(None).cast("string")).when(F.col("__in_target") == 1, "target_overlap").when(F.col("__lo") != F.col("__hi"), "across_groups")
    return df.join(per, content, "left").withColumn("dropped", reason).drop("__in_target", "__lo", "__hi")


def role_violations(df: DataFrame, *, partition: str, entity: str) -> DataFrame:
    """Entities that stand in more than one partition, with the partitions; empty if the roles are disjoint."""
    return df.groupBy(entity).agg(F.sort_array(F.collect_set(partition)).alias("partitions")).filter(F.size("partitions") > 1)


def without_common(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides without the keys that both hold."""
    common = left.select(key).intersect(right.select(key))
    return left.join(common, key, "left_anti"), right.join(common, key, "left_anti")


def keep_first(df: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``kept`` and ``retained``: the first row of each key in order, and for the others which one stayed."""
    run = W.partitionBy(*keys).orderBy(*order)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumn("kept", F.row_number().over(run) == 1).withColumn("retained", F.first(F.struct(*order)).over(whole))


def collisions(df: DataFrame, *, key: str, evidence: str) -> DataFrame:
    """Keys whose rows differ in ``evidence``."""
    return df.groupBy(key).agg(F.count_distinct(evidence).alias("versions")).filter("versions > 1")


def planned_units(left: DataFrame, right: DataFrame, excluded: DataFrame, *, on: list[str], unit_id: Column) -> DataFrame:
    """Every pair of a left and a right row but the excluded ones, with a deterministic id.

    The right side is a short list of work kinds; the product is the plan.
    """
    return left.crossJoin(right).join(excluded, on, "left_anti").withColumn("unit_id", unit_id)


def outer_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys that only one side holds; empty if the id sets are equal."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.filter("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def precedence(base: DataFrame, sources: list[tuple[str, DataFrame]], *, key: str, value: str, default: str) -> DataFrame:
    """``value`` and ``basis`` of the first source that has the key, in order, else the default."""
    out = base
    for name, df in sources:
        out = out.join(df.select(key, F.col(value).alias(f"__{name}")), key, "left")
    found = [F.col(f"__{n}") for n, _ in sources]
    basis = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for (n, _), c in zip(sources, found, strict=True)], F.lit("none"))
    return out.withColumn(value, F.coalesce(*found, F.lit(default))).withColumn("basis", basis).drop(*[f"__{n}" for n, _ in sources])


def missing_horizons(df: DataFrame, *, key: str, horizon: str, expected: list[int]) -> DataFrame:
    """Keys whose horizons are not exactly the expected ones."""
    want = F.array(*[F.lit(h) for h in sorted(expected)])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(horizon)).alias("horizons")).filter(F.col("horizons") != want)
