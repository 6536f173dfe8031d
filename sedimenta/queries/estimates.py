"""Estimates with intervals, tests of means, matching and line lineage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import lineage
from sedimenta.operators import matching as M
from sedimenta.operators import panel as D
from sedimenta.operators import quantify as K
from sedimenta.operators import survival as S
from sedimenta.queries import query, r6, table
from sedimenta.queries.panel import EFFECTS, contrasts
from sedimenta.queries.quantity import SCORED, scored


def draws_sql(source: str, cluster: str, replicates: int, seed: str) -> str:
    """CTEs ``clusters, draws, copies``: the same whole-cluster draws in SQL."""
    return f"""clusters AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT {cluster} AS c FROM {source})),
draws AS (SELECT b AS replicate, CAST(('0x' || substr(sha256('{seed}' || chr(0) || b || chr(0) || place), 1, 12)) AS BIGINT) % n AS place FROM clusters, (SELECT unnest(range({replicates})) AS b)),
copies AS (SELECT replicate, c, count(*) AS copies FROM draws JOIN clusters USING (place) GROUP BY replicate, c)"""


@query(
    f"""WITH {SCORED}, o AS (SELECT score AS v, weight AS u, row_number() OVER (ORDER BY score, weight) AS i, sum(weight) OVER (ORDER BY score, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(weight) OVER () AS total FROM scored),
m AS (SELECT v, (upto - u / 2) / total AS p FROM o), q AS (SELECT unnest(list_transform(range(1, 20), lambda i: i / 20.0)) AS probability),
n AS (SELECT probability, max((p, v)) FILTER (p <= probability) AS lo, min((p, v)) FILTER (p > probability) AS hi FROM q, m GROUP BY probability)
SELECT round(probability, 4) AS probability, round(CASE WHEN lo IS NULL THEN hi[2] WHEN hi IS NULL THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (probability - lo[1]) / (hi[1] - lo[1]) END, 6) AS value FROM n"""
)
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.weighted_quantiles(scored(spark, sf_dir), value="score", weight="weight", probabilities=[i / 20 for i in range(1, 20)])
    return out.select(F.round("probability", 4).alias("probability"), r6(F.col("value")).alias("value"))


@query(
    f"""WITH {SCORED}, {draws_sql("scored", "source", 2000, "both")},
per AS (SELECT source, sum(weight) FILTER (quality = 1) AS w1, sum(weight * score) FILTER (quality = 1) AS v1, sum(weight) FILTER (quality <> 1) AS w0, sum(weight * score) FILTER (quality <> 1) AS v0 FROM scored GROUP BY source),
r AS (SELECT replicate, sum(v1 * copies) / sum(w1 * copies) - sum(v0 * copies) / sum(w0 * copies) AS gap FROM per JOIN copies ON source = c GROUP BY replicate)
SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, count(gap) AS replicates FROM r"""
)
def cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    out = K.cluster_bootstrap(rows, S.cluster_draws(rows, cluster="source", replicates=2000, seed="both"), cluster="source", label=F.col("quality") == 1, score="score", weight="weight")
    return out.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "replicates")


@query(
    """WITH c AS (SELECT c_mktsegment AS stratum, c_nationkey AS nation, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus <> 'P') AS seen, count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
"""
    + draws_sql("c", "nation", 2000, "strata")
    + """, e AS (SELECT stratum, replicate, sum(good / nullif(seen, 0) * copies) / sum(CASE WHEN seen > 0 THEN copies END) AS balanced, sum(good * copies) / sum(seen * copies) AS pooled FROM c AS x JOIN copies AS k ON x.nation = k.c GROUP BY 1, 2),
s AS (SELECT stratum, quantile_cont(balanced, 0.025) AS bl, quantile_cont(balanced, 0.975) AS bh, quantile_cont(pooled, 0.025) AS pl, quantile_cont(pooled, 0.975) AS ph FROM e GROUP BY 1),
p AS (SELECT stratum, count(*) AS clusters, sum(seen) / sum(rows) AS coverage, avg(good / nullif(seen, 0)) AS balanced, sum(good) / sum(seen) AS pooled FROM c GROUP BY 1)
SELECT p.stratum, clusters, round(coverage, 6) AS coverage, round(p.balanced, 6) AS balanced, round(p.pooled, 6) AS pooled, CASE WHEN clusters >= 5 AND coverage >= 0.6 THEN round(bl, 6) END AS balanced_low, CASE WHEN clusters >= 5 AND coverage >= 0.6 THEN round(bh, 6) END AS balanced_high,
  CASE WHEN clusters >= 5 AND coverage >= 0.6 THEN round(pl, 6) END AS pooled_low, CASE WHEN clusters >= 5 AND coverage >= 0.6 THEN round(ph, 6) END AS pooled_high, concat_ws(',', CASE WHEN clusters < 5 THEN 'fewer_than_5_clusters' END, CASE WHEN NOT coverage >= 0.6 THEN 'coverage_below_0.60' END) AS reasons FROM p JOIN s ON p.stratum = s.stratum"""
)
def stratum_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    counts = orders.groupBy(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("nation")).agg(F.count_if(status == "F").alias("good"), F.count_if(status != "P").alias("seen"), F.count("*").alias("rows"))
    out = S.stratum_shares(counts, S.cluster_draws(counts, cluster="nation", replicates=2000, seed="strata"), stratum="stratum", cluster="nation", good="good", seen="seen", rows="rows", least_coverage=0.6)
    numbers = [c for c in out.columns if c not in ("stratum", "clusters", "reasons")]
    return out.select("stratum", "clusters", *[r6(F.col(c)).alias(c) for c in numbers], F.array_join("reasons", ",").alias("reasons"))


CRITICAL = "1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / 4 / d + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / 96 / d / d + (3 * pow(1.959963984540054, 7) + 19 * pow(1.959963984540054, 5) + 17 * pow(1.959963984540054, 3) - 15 * 1.959963984540054) / 384 / d / d / d"


@query(
    f"""WITH {EFFECTS}, s AS (SELECT seg, count(*) AS n, avg(effect) AS mean, abs(avg(effect)) / sqrt(var_samp(effect) / count(*)) AS t, nullif(count(*) - 1, 0) AS d FROM eff GROUP BY seg)
SELECT seg, n, round(mean, 4) AS mean, round(t, 6) AS t, round({CRITICAL}, 6) AS critical, CASE WHEN n > 1 THEN t <= {CRITICAL} ELSE abs(mean) <= 1e-12 END AS passed FROM s"""
)
def mean_zero_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.mean_zero_test(contrasts(spark, sf_dir), by=["seg"], value="effect")
    return out.select("seg", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), r6(F.col("t")).alias("t"), r6(F.col("critical")).alias("critical"), "passed")


@query(
    f"WITH {EFFECTS}, u AS (SELECT seg, cust, row_number() OVER (PARTITION BY seg ORDER BY cust) - 1 AS place, count(*) OVER (PARTITION BY seg) AS n FROM (SELECT DISTINCT seg, cust FROM eff)), "
    "d AS (SELECT seg, b AS replicate, CAST(('0x' || substr(sha256('effects' || chr(0) || seg || chr(0) || b || chr(0) || place), 1, 12)) AS BIGINT) % n AS place FROM u, (SELECT unnest(range(2000)) AS b)), "
    "c AS (SELECT d.seg, replicate, cust, count(*) AS copies FROM d JOIN u ON u.seg = d.seg AND u.place = d.place GROUP BY ALL), "
    "r AS (SELECT eff.seg, replicate, sum(effect * copies) / sum(copies) AS m FROM eff JOIN c ON eff.cust = c.cust AND eff.seg = c.seg GROUP BY 1, 2) "
    "SELECT seg, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high, count(*) AS replicates FROM r GROUP BY seg"
)
def effect_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean effect of each segment, whose adopters are drawn among themselves, over 2000 resamples."""
    out = D.drawn_effects(contrasts(spark, sf_dir), unit="cust", stratum="seg", effect="effect", replicates=2000, seed="effects")
    return out.select("seg", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "replicates")


@query()
def nearest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of a customer matched to open ones, same priority first, by scaled price and date, within a caliper."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"), F.year("o_orderdate").alias("year"))
    done = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = orders.join(done, "o_orderkey")
    return M.greedy_nearest(
        both.filter("o_orderstatus = 'F'"), both.filter("o_orderstatus <> 'F'"), block=["o_custkey"], unit="o_orderkey", numbers={"price": 100000.0, "day": 180.0}, labels=["year"], tier="o_orderpriority", caliper=4.0
    ).withColumn("distance", r6(F.col("distance")))


@query()
def synthetic_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the mixture fit on mixtures of known shares, drawn from whole sources."""
    rows = scored(spark, sf_dir).withColumn("side", F.when(F.col("quality") == 1, "agent").otherwise("human"))
    out = K.synthetic_recovery(rows, group="source", side="side", score="score", weight="weight", shares=[0.1, 0.5, 0.9], trials=50, picks=8, seed="synthetic")
    return out.select("share", r6(F.col("error")).alias("error"), r6(F.col("worst")).alias("worst"), "trials")


@query(
    """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type FROM events), f AS (SELECT user_id, k, 'l' || k AS line_id, min(k) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM c WHERE true)
SELECT user_id, line_id, coalesce(CAST(gone AS BIGINT), -1) AS gone FROM f WHERE k <= 3"""
)
def followed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit at which each of a repository's first three lines goes: every ``error`` event is a patch that removes all lines made before it.

    Events stand for commits; a line is made by the commit of its number.
    """
    from pyspark.sql import Window as W

    run = W.partitionBy("user_id").orderBy("ts", "event_id")
    commits = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(run).alias("k"))
    repository = F.col("user_id").cast("string")
    lines = commits.filter("k <= 3").select(repository.alias("repository"), F.concat(F.lit("l"), "k").alias("line_id"), F.concat(F.lit("f"), "k").alias("path"), F.lit(1).alias("line"), F.lit("x = 1").alias("text"), F.col("k").alias("position"))
    errors = commits.filter("event_type = 'error'").withColumn("file", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter("file < k")
    path = F.concat(F.lit("f"), "file")
    changes = errors.select(repository.alias("repository"), F.col("k").alias("position"), F.col("event_id").cast("string").alias("commit"), path.alias("old_path"), path.alias("path"), F.lit(1).alias("hunk"), F.lit("removed").alias("kind"), F.lit(1).alias("old_line"), F.lit(None).cast("int").alias("new_line"), F.lit("x = 1").alias("text"))
    states = lineage.replay(lines, changes).filter("state = 'deleted'")
    gone = states.groupBy("repository", "line_id").agg(F.min("position").cast("long").alias("gone"))
    out = lines.join(gone, ["repository", "line_id"], "left")
    return out.select(F.col("repository").cast("long").alias("user_id"), "line_id", F.coalesce("gone", F.lit(-1)).alias("gone"))


@query(
    """WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type AS e FROM events),
g AS (SELECT user_id, min(k) FILTER (e = 'error') AS lost FROM c GROUP BY user_id),
d AS (SELECT c.user_id, k, e FROM c JOIN g ON g.user_id = c.user_id WHERE lost IS NULL OR k <= lost)
SELECT user_id, CASE WHEN count(*) FILTER (e = 'error') > 0 THEN 'unobservable' WHEN count(*) FILTER (e = 'view') > 0 THEN 'modified' ELSE 'unchanged' END AS state,
  coalesce('f' || max(k) FILTER (e IN ('click', 'purchase')), 'f0') AS path, 1 + count(*) FILTER (e = 'signup') - count(*) FILTER (e = 'signup' AND k < mover) AS line, count(*) AS changes
FROM d JOIN (SELECT user_id AS u, coalesce(max(k) FILTER (e = 'click'), 0) AS mover FROM d GROUP BY 1) ON u = user_id GROUP BY user_id, mover"""
)
def followed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, file and line of one line of each repository after its last change; events stand for commits.

    ``click`` moves the line to the head of another file, ``purchase`` renames its file, ``view`` changes it a
    little, ``signup`` puts a line before it, and ``error`` replaces it by two lines like it, which ends it.
    """
    from pyspark.sql import Window as W

    run = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = W.partitionBy("user_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    kind, k = F.col("event_type"), F.col("k")
    event = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repository"), "user_id", "event_type", F.row_number().over(run).alias("k"))

    def text(n):
        return F.concat(F.lit("total = first + second - third * "), n.cast("string"))

    # where the line stands before each commit, and its text
    stood = event.select(
        "repository", k.alias("position"), "event_type",
        F.concat(F.lit("f"), F.coalesce(F.max(F.when(kind.isin("click", "purchase"), k)).over(before), F.lit(0)).cast("string")).alias("old_path"),
        F.coalesce(F.max(F.when(kind == "click", k)).over(before), F.lit(0)).alias("mover"),
        text(F.coalesce(F.max(F.when(kind == "view", k)).over(before), F.lit(0))).alias("text"),
        F.collect_list(F.when(kind == "signup", k)).over(before).alias("puts"),
    )
    line = F.size(F.filter("puts", lambda p: p > F.col("mover"))) + 1
    new_path = F.concat(F.lit("f"), F.col("position").cast("string"))

    def row(kind_, old_path, path, hunk, old_line, new_line, text_):
        return F.struct(old_path.alias("old_path"), path.alias("path"), F.lit(hunk).alias("hunk"), F.lit(kind_).alias("kind"), old_line.cast("int").alias("old_line"), new_line.cast("int").alias("new_line"), text_.alias("text"))

    none, old, what, words = F.lit(None), F.col("old_path"), F.col("event_type"), F.col("text")
    put = F.concat(F.lit("import module_"), F.col("position").cast("string"))
    rows = (
        F.when(what == "click", F.array(row("removed", old, old, 1, line, none, words), row("added", F.lit("/dev/null"), new_path, 1, none, F.lit(1), words)))
        .when(what == "purchase", F.array(row("added", old, new_path, 1, none, line + 1, put)))
        .when(what == "view", F.array(row("removed", old, old, 1, line, none, words), row("added", old, old, 1, none, line, text(F.col("position")))))
        .when(what == "signup", F.array(row("added", old, old, 1, none, F.lit(1), put)))
        .otherwise(F.array(row("removed", old, old, 1, line, none, words), row("added", old, old, 1, none, line, F.concat(words, F.lit("1"))), row("added", old, old, 1, none, line + 1, F.concat(words, F.lit("2")))))
    )
    changes = stood.select("repository", "position", new_path.alias("commit"), F.inline(rows))
    lines = event.filter("k = 1").select("repository", F.lit("l").alias("line_id"), F.lit("f0").alias("path"), F.lit(1).alias("line"), text(F.lit(0)).alias("text"), F.lit(0).alias("position"))
    last = lineage.replay(lines, changes).groupBy("repository").agg(F.max_by(F.struct("state", "path", "line"), "position").alias("last"), F.count("*").alias("changes"))
    return last.select(F.col("repository").cast("long").alias("user_id"), "last.state", "last.path", F.col("last.line").cast("long").alias("line"), "changes")
