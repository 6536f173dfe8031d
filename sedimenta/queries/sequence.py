"""Ordered rows: the event stream by user, and the lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators import sequence as Q
from sedimenta.queries import query, r6, table


@query("SELECT event_id, round(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS gap FROM events")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.gaps(table(spark, sf_dir, "events"), by=["user_id"], order=["ts", "event_id"], at=F.col("ts"), name="gap")
    return out.select("event_id", r6(F.col("gap")).alias("gap"))


@query(
    """WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, count(b.event_id) AS earlier FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i < a.i AND b.ts >= a.ts - INTERVAL 12 HOUR GROUP BY a.event_id"""
)
def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.trailing_count(table(spark, sf_dir, "events"), by=["user_id"], order=["ts", "event_id"], at=F.col("ts"), seconds=12 * 3600, name="earlier")
    return out.select("event_id", "earlier")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, CASE WHEN lag(l_linenumber) OVER w = l_linenumber - 1 AND lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM f)
SELECT l_orderkey, CAST(run AS BIGINT) AS run, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS rows FROM r GROUP BY l_orderkey, run, l_returnflag"""
)
def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return Q.islands(rows, by=["l_orderkey"], position="l_linenumber", same=["l_returnflag"])


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber AS lo, l_linenumber + 1 AS hi, count(*) OVER (PARTITION BY l_orderkey) + 1 AS top FROM lineitem),
f AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi) = lo, lo = 1) AS fits FROM l)
SELECT l_orderkey, bool_and(fits) AND max(hi) = max(top) AS tiled FROM f GROUP BY l_orderkey"""
)
def line_tilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    rows = rows.withColumn("top", F.count("*").over(W.partitionBy("l_orderkey")) + 1)
    return Q.tiles(rows, by=["l_orderkey"], start="lo", end="hi", last=F.col("top"))


DECISION = "CASE WHEN value < 20 THEN 'reject' WHEN value < 60 THEN 'insufficient' WHEN value < 62 THEN NULL WHEN value < 64 THEN 'ambiguous' ELSE 'accept' END"


@query(
    f"""WITH e AS (SELECT user_id, {DECISION} AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
m AS (SELECT user_id, min(p) FILTER (decision = 'accept') AS acc, min(p) FILTER (decision IS NULL OR decision NOT IN ('accept', 'reject', 'insufficient')) AS pend FROM e GROUP BY user_id),
s AS (SELECT *, least(acc, pend) AS stop, CASE WHEN acc IS NOT NULL AND (pend IS NULL OR acc < pend) THEN 'accepted' WHEN pend IS NOT NULL THEN 'active' ELSE 'exhausted' END AS state FROM m)
SELECT s.user_id, CAST(count(*) FILTER (stop IS NULL OR p <= stop) AS INTEGER) AS eligible, CAST(count(decision) FILTER (stop IS NULL OR p <= stop) AS INTEGER) AS completed,
  any_value(CASE WHEN state = 'active' THEN pend END) AS active, any_value(state) AS state FROM s JOIN e USING (user_id) GROUP BY s.user_id"""
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("decision", F.expr(DECISION)).withColumn("p", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return Q.stop_rule(events, by=["user_id"], position="p", decision="decision", accept="accept", skip=["reject", "insufficient"])


@query(
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS stratum FROM events),
c AS (SELECT *, sum((stratum = 'high')::INT) OVER w AS h, sum((stratum = 'low')::INT) OVER w AS l FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, coalesce(max((h >= 2 AND l >= 2)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT event_id, user_id, stratum FROM b WHERE before = 0"""
)
def quota_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("stratum", F.when(F.col("value") >= 50, "high").otherwise("low"))
    out = Q.until_quota(events, by=["user_id"], order=[F.desc("ts"), F.desc("event_id")], stratum="stratum", quotas={"high": 2, "low": 2})
    return out.select("event_id", "user_id", "stratum")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
l AS (SELECT user_id, event_id, p, ts + INTERVAL 3 DAY AS target FROM e WHERE event_type = (SELECT min(event_type) FROM events))
SELECT l.user_id, l.event_id, max_by(r.event_id, r.p) AS snapshot FROM l LEFT JOIN e r ON r.user_id = l.user_id AND r.ts <= l.target AND r.p >= l.p GROUP BY l.user_id, l.event_id"""
)
def horizon_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("p", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = events.agg(F.min("event_type").alias("kind"))
    left = events.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).select("user_id", "event_id", F.col("p").alias("least"), F.expr("ts + interval 3 days").alias("target"))
    right = events.select("user_id", "ts", "p", F.col("event_id").alias("snapshot_id"))
    out = Q.as_of(left, right, by=["user_id"], target="target", time="ts", position="p", least="least", value="snapshot_id")
    return out.select("user_id", "event_id", F.col("found").alias("snapshot"))


@query(
    """WITH g AS (SELECT event_id, ts, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT event_id, round(ln(1 + greatest(gap, 0)), 6) AS log_gap, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_cos FROM g"""
)
def timing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Q.gaps(table(spark, sf_dir, "events"), by=["user_id"], order=["ts", "event_id"], at=F.col("ts"), name="gap")
    turn = lambda x, period: 2 * F.pi() * x / F.lit(period)
    hour, day = turn(F.hour("ts"), 24), turn(F.weekday("ts"), 7)
    waves = {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}
    return events.select("event_id", r6(F.log1p(F.greatest(F.col("gap"), F.lit(0.0)))).alias("log_gap"), *[r6(c).alias(n) for n, c in waves.items()])
