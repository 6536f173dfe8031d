"""Mixing sources to target weights by Pareto order sampling.

A document of weight ``w`` should appear ``e = min(max_repeat, c w)`` times on
average, where the scale ``c`` of its source makes the words expected equal to the
source's target; what documents at the limit leave over is so shared again among
the others.  The whole part ``floor(e)`` is certain.  For the fraction ``p`` a
document gets the rank

    (u / (1 - u)) / (p / (1 - p))        u uniform in (0, 1), from a hash of its id

and the documents of lowest rank, up to the words still missing, are taken once
more: random odds over inclusion odds.  A document's copies therefore depend only on
its own row and on a few numbers of its source, so nothing of the size of the corpus
is sorted in one place: the rank at which a source is cut is found from sums over
about ``sqrt(n)`` rank bins and then inside the one bin where the cut falls.

Defined results: a null text has size 0; null is a source of its own, last; null or
non-positive document weights count as never taken; rows without an id are told
apart by the hash of their columns; rows alike in everything tie, and of those at
the cut as many are taken as bring the source nearest to its target; an empty table
gives an empty mix; other columns, whatever their names, pass through but for the
four that the result replaces; a very long text is one row like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.text import quoted, set_aside
from sedimenta.plans.scratch import discard, materialize

_SRC, _ID, _SIZE, _WEIGHT, _ROW = "__mix_source", "__mix_id", "__mix_size", "__mix_weight", "__mix_row"


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], max_repeat: int) -> DataFrame:
    """``(source, source_size, n_docs, weighted, target)`` from narrow rows.

    Sources in code-point order, null last, weigh ``cycle`` repeating and share
    the sum of all sizes.  A target stops at ``max_repeat`` times its source's
    size; what is above is shared again by weight.  The result is the level
    ``l`` with ``sum(min(cap, l * weight)) = total``, which the running sums of
    the sources in order of ``cap / weight`` give without iterating.  The
    windows run over one row a source.
    """
    per = sizes.groupBy(_SRC).agg(
        F.sum(_SIZE).alias("source_size"),
        F.count("*").alias("n_docs"),
        F.sum(F.col(_WEIGHT) * F.col(_SIZE)).alias("weighted"),
    )
    by_name = W.orderBy(F.col(_SRC).asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    cap = F.lit(max_repeat) * F.col("source_size")
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("rank"))
    return (
        per.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("filled", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))))
        .select(_SRC, "source_size", "n_docs", "weighted", "target")
    )


def _scaled(rows: DataFrame, plan: DataFrame, max_repeat: int) -> DataFrame:
    """``plan`` with the ``scale`` of every source: copies expected for a weight of 1.

    Rows at the limit only become more from step to step, so this ends; a step sums
    up one row a source and weight, and the driver sees one yes or no.
    """
    sums = materialize(rows.groupBy(F.col(_SRC).alias("__s"), _WEIGHT).agg(F.sum(_SIZE).alias("words")))
    # weights are compared with the limit a hair below it, as the scale is rounded
    limit = max_repeat * (1 - 1e-12)
    now = plan.withColumn("scale", F.coalesce(F.try_divide("target", "weighted"), F.lit(0.0)))
    while True:
        now = materialize(now)
        met = sums.join(F.broadcast(now.select(_SRC, "scale")), F.col("__s").eqNullSafe(F.col(_SRC)))  # a row a source
        full = F.col("scale") * F.col(_WEIGHT) >= limit
        left = met.groupBy("__s").agg(
            F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).alias("full"),
            F.sum(F.when(~full, F.col("words") * F.col(_WEIGHT))).alias("open"),
        )
        step = now.join(left, F.col(_SRC).eqNullSafe(F.col("__s")), "left").drop("__s")
        new = F.coalesce(F.try_divide(F.col("target") - max_repeat * F.col("full"), "open"), F.col("scale"))
        after = materialize(step.withColumn("new", F.greatest("scale", new)).drop("full", "open"))
        discard(now)
        moved = not after.filter(F.col("new") > F.col("scale") * (1 + 1e-12)).isEmpty()
        now = after.withColumn("scale", F.col("new")).drop("new")
        if not moved:
            discard(sums)
            return now


def _ranked(rows: DataFrame, plan: DataFrame, max_repeat: int, seed: str) -> DataFrame:
    """Adds the source's row of ``plan`` as a struct, the certain copies and the Pareto rank."""
    key = F.concat_ws("|", F.coalesce(F.col(_ID).cast("string"), F.concat(F.lit("null"), F.col(_ROW).cast("string"))), F.col(_SIZE).cast("string"))
    by_source = plan.select(F.col(_SRC).alias("__key"), F.struct(*[c for c in plan.columns if c != _SRC]).alias("__plan"))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("__e") - F.col("__whole")))
    return (
        rows.join(F.broadcast(by_source), F.col(_SRC).eqNullSafe(F.col("__key")), "left")  # a row a source
        .withColumn("__e", F.least(F.lit(float(max_repeat)), F.col("__plan.scale") * F.col(_WEIGHT)))
        .withColumn("__whole", F.floor("__e"))
        .withColumn("__u", uniform(key, seed))
        .withColumn("__rank", (F.col("__u") / (1 - F.col("__u"))) / (p / (1 - p)))
        .withColumn("__more", (F.col("__whole") < max_repeat) & (F.col(_WEIGHT) > 0) & (F.col(_SIZE) > 0))
    )


def _keys(docs: DataFrame, id_col: str, source_col: str, size: Column, weight: Column | None) -> dict[str, Column]:
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return {
        _SRC: F.col(quoted(source_col)),
        _ID: F.col(quoted(id_col)),
        _SIZE: F.coalesce(size.cast("long"), F.lit(0).cast("long")),
        _WEIGHT: w,
        _ROW: F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]),
    }


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column,
    weight: Column | None = None,
    cycle: tuple[float, ...] = (1, 2, 3),
    max_repeat: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row a source: its size, target, scale, the rank at which it is cut, and how many rows of just that rank are taken."""
    rows = materialize(docs.select(*[c.alias(n) for n, c in _keys(docs, id_col, source_col, size, weight).items()]))
    plan = _scaled(rows, source_targets(rows, cycle, max_repeat), max_repeat)
    ranked = _ranked(rows, plan, max_repeat, seed)
    certain = ranked.groupBy(_SRC).agg(F.sum(F.col("__whole") * F.col(_SIZE)).alias("certain"))
    need = materialize(
        plan.join(certain.withColumnRenamed(_SRC, "__c"), F.col(_SRC).eqNullSafe(F.col("__c")), "left")
        .drop("__c")
        .withColumn("missing", F.col("target") - F.coalesce(F.col("certain"), F.lit(0)))
        .withColumn("bins", F.ceil(F.sqrt("n_docs")).cast("long"))
    )
    first = _cuts(rows, need.withColumn("after", F.lit(-1.0)), max_repeat, seed)
    # where the row at the cut was too large to take, those after it fill what is still missing
    again = materialize(need.drop("missing").join(first, F.col(_SRC).eqNullSafe(F.col("__cs")), "left").withColumn("missing", F.coalesce("rest", F.lit(0.0))).withColumn("after", F.coalesce("cut", F.lit(-1.0))))
    refill = _cuts(rows, again.select(*need.columns, "after"), max_repeat, seed)
    second = refill.select(F.col("__cs").alias("__cs2"), F.col("cut").alias("cut2"), (F.col("at_cut") == F.col("tied")).alias("whole2"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = materialize(
        again.join(second, F.col(_SRC).eqNullSafe(F.col("__cs2")), "left")
        .withColumn("cut", F.coalesce("cut", F.lit(-1.0)))
        .select(_SRC, "source_size", "n_docs", "weighted", "target", "scale", "cut", zero("at_cut"), zero("tied"), F.coalesce("cut2", F.lit(-1.0)).alias("cut2"), F.coalesce("whole2", F.lit(False)).alias("whole2"))
    )
    discard(rows, need, first, again, refill)
    return out


def _cuts(rows: DataFrame, need: DataFrame, max_repeat: int, seed: str) -> DataFrame:
    """For each source the last rank above ``after`` before which words are missing, how many of its rows are taken, and what is missing then."""
    # the cut lies near rank 1, the middle of rank / (1 + rank), where no bin is overfull
    bins = F.col("__plan.bins")
    opened = _ranked(rows, need, max_repeat, seed).filter(F.col("__more") & (F.col("__rank") > F.col("__plan.after")))
    binned = opened.withColumn("__bin", F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * bins), bins - 1))
    sums = binned.groupBy(_SRC, "__bin").agg(F.sum(_SIZE).alias("words"), F.first("__plan.missing").alias("missing"))
    run = W.partitionBy(_SRC).orderBy("__bin")
    cut_bin = materialize(
        sums.withColumn("upto", F.sum("words").over(run))
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("last", F.max("__bin").over(W.partitionBy(_SRC)))
        .filter((F.col("before") < F.col("missing")) & ((F.col("upto") >= F.col("missing")) | (F.col("__bin") == F.col("last"))))
        .select(F.col(_SRC).alias("__cs"), F.col("__bin").alias("__cb"), "before")
    )
    inside = binned.join(F.broadcast(cut_bin), F.col(_SRC).eqNullSafe(F.col("__cs")) & (F.col("__bin") == F.col("__cb")))  # a row a source
    ties = inside.groupBy(_SRC, "__rank").agg(F.sum(_SIZE).alias("words"), F.count("*").alias("rows"), F.first("__plan.missing").alias("missing"), F.first("before").alias("before"))
    run = W.partitionBy(_SRC).orderBy("__rank")
    last = (
        ties.withColumn("upto", F.col("before") + F.sum("words").over(run))
        .filter(F.col("upto") - F.col("words") < F.col("missing"))
        .groupBy(_SRC)
        .agg(F.max_by(F.struct("__rank", "upto", "words", "rows", "missing"), "__rank").alias("c"))
    )
    # of its rows as many as come nearest, in proportion to their mean size
    each = F.col("c.words") / F.col("c.rows")
    open_words = F.col("c.missing") - (F.col("c.upto") - F.col("c.words"))
    some = F.least(F.col("c.rows"), F.greatest(F.lit(0), F.round(open_words / each))).cast("long")
    out = materialize(last.select(F.col(_SRC).alias("__cs"), F.col("c.__rank").alias("cut"), some.alias("at_cut"), F.col("c.rows").alias("tied"), (open_words - some * each).alias("rest")))
    discard(cut_bin)
    return out


def pareto_mix(
    docs: DataFrame,
    plan: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column,
    weight: Column | None = None,
    max_repeat: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` under a plan of :func:`mix_plan`.

    ``copies`` is how often the mix holds the document, from 0 to ``max_repeat``.
    Only rows that tie at the cut, which must be alike, are numbered to tell them
    apart; all others are decided where they stand.
    """
    rows, names = set_aside(docs, **_keys(docs, id_col, source_col, size, weight))
    ranked = _ranked(rows, plan, max_repeat, seed)
    at_cut = F.col("__more") & (F.col("__rank") == F.col("__plan.cut"))
    several = F.coalesce(at_cut & (F.col("__plan.tied") > 1), F.lit(False))
    below = (F.col("__more") & (F.col("__rank") < F.col("__plan.cut"))) | (at_cut & (F.col("__plan.at_cut") > 0))
    number = F.row_number().over(W.partitionBy(_SRC).orderBy(_ROW))
    tied = ranked.filter(several).withColumn("__again", number <= F.col("__plan.at_cut"))
    below = below | (F.col("__more") & (F.col("__rank") > F.col("__plan.cut")) & ((F.col("__rank") < F.col("__plan.cut2")) | ((F.col("__rank") == F.col("__plan.cut2")) & F.col("__plan.whole2"))))
    rows = ranked.filter(~several).withColumn("__again", F.coalesce(below, F.lit(False))).unionByName(tied)
    return rows.select(
        *[F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("size", "source_size", "target", "copies")],
        F.col(_SIZE).alias("size"),
        F.col("__plan.source_size").alias("source_size"),
        F.col("__plan.target").alias("target"),
        (F.col("__whole") + F.col("__again").cast("long")).alias("copies"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM per),
weighed AS (SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS w, sum(source_size) OVER () AS total FROM ranked),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
lvl AS (SELECT min_by(lv, cap / w + r * 1e-12) FILTER (lv * w <= cap) AS lv FROM levels),
targets AS (SELECT l.source, l.source_size, least(CAST(cap AS DOUBLE), coalesce(x.lv * w, CAST(cap AS DOUBLE))) AS target FROM levels l, lvl x),
by_weight AS (SELECT source, ln(1 + CAST(size AS DOUBLE)) AS w, sum(size) AS s FROM docs GROUP BY ALL),
filled AS (SELECT b.source, b.w, t.target, coalesce(sum(s) OVER (PARTITION BY b.source ORDER BY b.w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
   sum(s * b.w) OVER (PARTITION BY b.source ORDER BY b.w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM by_weight b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
scales AS (SELECT source, coalesce(arg_max((target - 3 * above) / nullif(open, 0), w) FILTER ((target - 3 * above) / nullif(open, 0) * w < 3 * (1 - 1e-12)), 1e9) AS c FROM filled GROUP BY source),
rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(3.0, c * ln(1 + CAST(d.size AS DOUBLE))) AS e,
    (CAST(('0x' || substr(md5('mix:' || d.doc_id || '|' || CAST(d.size AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN scales x ON d.source IS NOT DISTINCT FROM x.source),
odds AS (SELECT *, floor(e) AS whole, greatest(1e-12, least(1 - 1e-12, e - floor(e))) AS p FROM rated),
ranks AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS k, whole < 3 AND size > 0 AS open FROM odds),
certain AS (SELECT source, any_value(target) - sum(whole * size) AS missing FROM ranks GROUP BY source),
running AS (SELECT r.source, k, size, missing, sum(size) OVER (PARTITION BY r.source ORDER BY k) AS upto FROM ranks r JOIN certain c ON r.source IS NOT DISTINCT FROM c.source WHERE open),
cuts AS (SELECT source, max(k) AS cut, arg_max(missing - (upto - size) >= size / 2.0, k) AS taken, arg_max(missing - (upto - size) - CASE WHEN missing - (upto - size) >= size / 2.0 THEN size ELSE 0 END, k) AS rest FROM running WHERE upto - size < missing GROUP BY source),
running2 AS (SELECT r.source, r.k, r.size, rest, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k) AS upto FROM running r JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source WHERE r.k > cut),
cuts2 AS (SELECT source, max(k) AS cut2, arg_max(rest - (upto - size) >= size / 2.0, k) AS taken2 FROM running2 WHERE upto - size < rest GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(r.size * (whole + CASE WHEN open AND (k < cut OR k = cut AND taken OR k > cut AND (k < cut2 OR k = cut2 AND taken2)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranks r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source LEFT JOIN cuts2 d ON r.source IS NOT DISTINCT FROM d.source
"""
