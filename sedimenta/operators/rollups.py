"""Filters, recodes and roll-ups of cohorts, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def merged(x: Column, groups: dict[str, list[str]]) -> Column:
    """The name of the group that holds the value, else the value itself."""
    out = x
    for name, values in groups.items():
        out = F.when(x.isin(*values), name).otherwise(out)
    return out


def without_columns(df: DataFrame, drop: list[str]) -> DataFrame:
    """All feature columns but those that equal or start with an entry of ``drop``."""
    return df.select(*[c for c in df.columns if not any(c == d or c.startswith(d + "_") for d in drop)])


def kind_counts(df: DataFrame, *, by: list[str], kind: Column, kinds: list[str]) -> DataFrame:
    """Rows of each kind by group as one map, kinds without rows as 0."""
    counts = [F.count_if(kind == k) for k in kinds]
    return df.groupBy(*by).agg(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*counts)).alias("kinds"))


def first_matching(df: DataFrame, *, by: list[str], order: list[str], match: Column, value: str) -> DataFrame:
    """The first row in order that matches, with its time; groups without one are absent."""
    return df.filter(match).groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value), F.min(order[0]).alias("at"))


def eligible_windows(df: DataFrame, *, at: str, clean: int, before: int, after: int, start: str, cutoff: str, flags: Column) -> DataFrame:
    """Rows whose window of ``clean`` and ``before`` days earlier and ``after`` days later lies in [start, cutoff], and whose flags hold."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(cutoff).cast("timestamp")
    day = lambda n: F.make_dt_interval(F.lit(n))
    return df.filter(flags & (F.col(at) - day(clean) >= lo) & (F.col(at) - day(before) >= lo) & (F.col(at) + day(after) <= hi))


def safe_controls(policies: DataFrame, agents: DataFrame, index: DataFrame, *, key: str, status: str) -> DataFrame:
    """Policy rows whose repository is no agent's and has no dated adoption."""
    dated = index.filter(F.col(status).startswith("dated")).select(key)
    return policies.join(agents.select(key), key, "left_anti").join(dated, key, "left_anti")


def conflicting_labels(df: DataFrame, *, by: str, label: str) -> DataFrame:
    """Units with more than one label; empty if the reference is sound."""
    return df.groupBy(by).agg(F.count_distinct(label).alias("labels")).filter("labels > 1")


def recoded(state: Column, *, structural: bool) -> Column:
    """``modified_candidate`` counts as modified if structural matches count, else as unobservable."""
    return F.when(state == "modified_candidate", "modified" if structural else "unobservable").otherwise(state)


def forbidden_fields(schema: DataType, forbidden: set[str], path: str = "") -> list[str]:
    """Paths of the fields, at any depth, whose names are forbidden; a property of the schema, no row is read."""
    if isinstance(schema, StructType):
        own = [f"{path}{f.name}" for f in schema if f.name in forbidden]
        return own + [p for f in schema for p in forbidden_fields(f.dataType, forbidden, f"{path}{f.name}.")]
    if isinstance(schema, ArrayType):
        return forbidden_fields(schema.elementType, forbidden, f"{path}[].")
    return forbidden_fields(schema.valueType, forbidden, f"{path}{{}}.") if isinstance(schema, MapType) else []


def remapped(df: DataFrame, *, field: str, names: dict[str, str]) -> DataFrame:
    """Provisional reasons of a column (``a.b`` for one inside a struct) by their final names; others stay."""
    outer, _, inner = field.partition(".")
    value = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(field)), F.col(field))
    return df.withColumn(outer, F.col(outer).withField(inner, value) if inner else value)


def mixture_table(df: DataFrame, *, population: str, features: list[str], least_ratio: float = 0.6, least_gap: float = 0.3) -> DataFrame:
    """Share of agent code that each feature's mean implies, by feature and agent population, one row each.

    ``population`` is PRE, HUMAN_MODERN, SIGNED, OWN or UNSIGNED.  A feature counts
    if modern humans explain at most ``1 - least_ratio`` of its move from PRE to
    SIGNED, and if the gap of agents to humans is at least ``least_gap`` deviations
    of all rows (else ``thin``); shares outside [0, 1] are cut and told.
    """
    long = df.unpivot([population], features, "feature", "value")
    mean = lambda p: F.avg(F.when(F.col(population) == p, F.col("value")))
    m = long.groupBy("feature").agg(mean("PRE").alias("pre"), mean("HUMAN_MODERN").alias("human"), mean("SIGNED").alias("signed"), mean("OWN").alias("own"), mean("UNSIGNED").alias("unsigned"), F.stddev_pop("value").alias("sd"))
    ratio = F.when(F.abs(F.col("signed") - F.col("pre")) >= 1e-9, (F.col("signed") - F.col("human")) / (F.col("signed") - F.col("pre")))
    each = m.withColumn("ratio", ratio).filter(F.col("ratio") >= least_ratio)
    each = each.select("feature", "ratio", "sd", "human", "unsigned", F.explode(F.create_map(F.lit("SIGNED"), F.col("signed"), F.lit("OWN"), F.col("own"))).alias("agents", "mean"))
    gap = F.col("mean") - F.col("human")
    thin = (F.col("sd") <= 0) | (F.abs(gap) < least_gap * F.col("sd"))
    share = F.when(~thin & (F.abs(gap) >= 1e-9), (F.col("unsigned") - F.col("human")) / gap)
    return each.select("feature", "agents", "ratio", thin.alias("thin"), ((share < 0) | (share > 1)).alias("clipped"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("share"))


def total_share(share: Column, signed: Column, unsigned: Column) -> Column:
    """Share of all lines: the signed ones and that part of the unsigned ones."""
    return F.try_divide(signed + share * unsigned, signed + unsigned)


def identified_total(df: DataFrame, *, share: str, conservative: str, signed: str, unsigned: str, identified: Column) -> DataFrame:
    """Shares over the identified strata, by their lines, and how much of all lines these cover; a share that is no number counts as 0."""
    finite = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    lines, on = F.col(signed) + F.col(unsigned), F.when(identified, 1).otherwise(0)
    total = lambda c: F.try_divide(F.sum(on * (F.col(signed) + finite(c) * F.col(unsigned))), F.sum(on * lines))
    return df.agg(F.sum(on).alias("strata"), total(share).alias("share"), total(conservative).alias("conservative"), F.try_divide(F.sum(on * lines), F.sum(lines)).alias("coverage"))


def line_rollup(df: DataFrame, *, unit: str, stratum: str, lines: str, substantial: int) -> DataFrame:
    """Rows and lines by unit and stratum and by unit alone (``stratum`` null), and whether the unit is substantial."""
    out = df.rollup(unit, stratum).agg(F.count("*").alias("hunks"), F.sum(lines).alias("lines"), F.grouping_id().alias("__g")).filter("__g < 3")
    whole = F.max(F.when(F.col("__g") == 1, F.col("lines"))).over(W.partitionBy(unit))
    return out.withColumn("substantial", whole >= substantial).drop("__g")


def state_pivot(df: DataFrame, *, by: list[str], horizon: str, state: str, states: list[str], line: str, observable: list[str]) -> DataFrame:
    """Rows of each state by horizon, distinct lines, and the share that is observable."""
    out = df.groupBy(*by, horizon).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count_distinct(line).alias("lines"), F.count("*").alias("rows"))
    return out.withColumn("coverage", F.round(sum((F.col(s) for s in observable[1:]), F.col(observable[0])) / F.col("rows"), 6)).drop("rows")


def planned_totals(plan: DataFrame, units: DataFrame, *, key: str, lines: str, weight: str) -> DataFrame:
    """Units, lines and weighted lines of every planned repository, 0 where nothing was found."""
    per = units.groupBy(key).agg(F.count("*").alias("units"), F.sum(lines).alias("lines"), F.sum(F.col(lines) * F.col(weight)).alias("weighted"))
    return plan.select(key).join(per, key, "left").fillna(0, ["units", "lines", "weighted"])


def frequencies(df: DataFrame, *, columns: list[str], status: Column) -> DataFrame:
    """How often each value of each column stands in rows of the wanted status; null is a value."""
    rows = df.filter(status).select(*[F.col(c).cast("string").alias(c) for c in columns])
    return rows.unpivot([], columns, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def agreement_by(df: DataFrame, *, by: list[str], first: str, second: str, unresolved: list[str]) -> DataFrame:
    """Cases, exact agreement and unresolved answers, overall (all ``by`` null) and by stratum."""
    same, open_ = F.col(first) == F.col(second), F.col(first).isin(*unresolved) | F.col(second).isin(*unresolved)
    out = df.groupingSets([[], [F.col(c) for c in by]], *[F.col(c) for c in by]).agg(F.count("*").alias("cases"), F.count_if(same).alias("agreed"), F.count_if(open_).alias("unresolved"))
    return out.withColumn("agreement", F.col("agreed") / F.col("cases"))


def exists_selected(tasks: DataFrame, *, task: str, selected: Column) -> DataFrame:
    """Tasks of which any observation is selected, with how many."""
    return tasks.groupBy(task).agg(F.count_if(selected).alias("selected")).filter("selected > 0")


def top_weights(df: DataFrame, *, name: str, weight: str, k: int, controls: list[str]) -> DataFrame:
    """The k features of largest absolute weight, controls left out; ties by name."""
    return df.filter(~F.col(name).isin(*controls)).orderBy(F.abs(weight).desc(), name).limit(k)


def inconsistent(df: DataFrame, *, by: list[str], columns: list[str]) -> DataFrame:
    """Groups in which a column that must be constant is not, one row for each such column."""
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(by, columns, "field", "value")
    return long.groupBy(*by, "field").agg(F.count_distinct("value").alias("values")).filter("values > 1")


def control_roles(df: DataFrame, *, by: str, control: str, role: str, roles: dict[str, str]) -> DataFrame:
    """Sorted ids of matched controls by role; ``roles`` maps stored role names to those reported."""
    named = df.withColumn("__role", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col(role)), F.col(role)))
    out = sorted({*roles.values()})
    return named.groupBy(by).agg(*[F.sort_array(F.collect_list(F.when(F.col("__role") == r, F.col(control)))).alias(r) for r in out])


def gated_effects(df: DataFrame, *, by: list[str], effect: str, pretrend: str, copies: str, controls: Column, least_adopters: int, least_controls: int) -> DataFrame:
    """Mean effect and pretrend by stratum, weighted by copies, null with reasons where a gate fails."""
    m, p = F.col(copies), F.col(pretrend)
    out = df.groupBy(*by).agg(
        F.sum(m).alias("adopters"),
        F.max(controls).alias("controls"),
        F.try_divide(F.sum(F.col(effect) * m), F.sum(m)).alias("effect"),
        F.try_divide(F.sum(p * m), F.sum(F.when(p.isNotNull(), m))).alias("pretrend"),
    )
    few = lambda c, n: F.when(F.col(c) < n, f"fewer than {n} {c}")
    out = out.withColumn("reasons", F.array_compact(F.array(few("adopters", least_adopters), few("controls", least_controls))))
    ok = F.size("reasons") == 0
    return out.withColumn("effect", F.when(ok, F.col("effect"))).withColumn("pretrend", F.when(ok, F.col("pretrend")))


def all_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds ``failed``, the names of the gates that do not hold (null does not), and ``identified``."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    return df.withColumn("failed", failed).withColumn("identified", F.size("failed") == 0)


def diversity_gates(df: DataFrame, *, by: list[str], group: str, lines: str, substantial: int, least: int) -> DataFrame:
    """Substantial groups of every cell, and whether they are as many as planned."""
    per = df.groupBy(*by, group).agg(F.sum(lines).alias("l"))
    return per.groupBy(*by).agg(F.count_if(F.col("l") >= substantial).alias("groups")).withColumn("passed", F.col("groups") >= least)


def state_before(transitions: DataFrame, points: DataFrame, *, key: str, at: str, state: str, time: str, start: str = "unchanged") -> DataFrame:
    """The state of each line strictly before each time: its last transition earlier than that, else ``start``.

    Transitions and points are put in one order and the last state is carried
    along, so a point does not meet every transition of its line.
    """
    a = transitions.select(key, F.col(at).alias(time), F.lit(1).alias("__kind"), F.col(state).alias("__state"))
    b = points.select(key, F.col(time).alias(time), F.lit(0).alias("__kind"), F.lit(None).cast("string").alias("__state"))
    run = W.partitionBy(key).orderBy(time, "__kind").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(state, F.coalesce(F.last("__state", ignorenulls=True).over(run), F.lit(start))).filter("__kind = 0").select(key, time, state)


def horizon_rows(lines: DataFrame, states: DataFrame, *, key: str, horizons: list[int], start: str) -> DataFrame:
    """One row for every line and horizon, with its state, or ``missing`` where none was observed."""
    want = lines.select(key, start).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    out = want.join(states, [key, "horizon"], "left")
    return out.withColumn("state", F.coalesce("state", F.lit("missing"))).withColumn("target", F.col(start) + F.make_dt_interval(F.col("horizon")))


def covered(keys: DataFrame, facts: DataFrame, *, key: str, by: str) -> DataFrame:
    """Keys of each unit that have a fact, and whether all of them have."""
    marked = keys.select(by, key).distinct().join(facts.select(key).distinct().withColumn("__has", F.lit(1)), key, "left")
    return marked.groupBy(by).agg(F.count("*").alias("keys"), F.count("__has").alias("found")).withColumn("whole", F.col("keys") == F.col("found"))


def recomputed(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that only one of a stored result and its recomputation has, with the side; empty if they are equal."""
    gone, new = stored.exceptAll(again), again.exceptAll(stored)
    return gone.withColumn("side", F.lit("stored")).unionByName(new.withColumn("side", F.lit("recomputed")))


def frozen_violations(df: DataFrame, frozen: dict[str, object]) -> DataFrame:
    """One row for each frozen constant that a protocol row does not hold."""
    each = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"), F.lit(str(v)).alias("frozen"))) for k, v in frozen.items()]
    return df.select(F.explode(F.array_compact(F.array(*each))).alias("v")).select("v.*")
