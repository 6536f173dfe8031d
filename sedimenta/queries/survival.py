"""Line histories: shipment lag after the order, return flag R as deletion, A as modification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import survival as S
from sedimenta.queries import query, r6, table

HORIZONS = [30, 90, 180, 365]
LINES = """lines AS (
  SELECT o_custkey AS cust, o_orderpriority AS priority, l_orderkey, l_linenumber, l_quantity, l_returnflag AS flag, l_linestatus AS status,
    date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE))"""
KM = """per AS (SELECT {by} lag, sum(weight) AS ended, sum(CASE WHEN flag = 'R' THEN weight ELSE 0 END) AS died, count(*) AS n FROM weighted GROUP BY {by} lag),
risk AS (SELECT *, sum(ended) OVER (PARTITION BY {part} ORDER BY lag DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM per),
curve AS (SELECT *, product(1 - died / at_risk) OVER (PARTITION BY {part} ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM risk)
SELECT {by} h.horizon, round(coalesce(max_by(s, lag) FILTER (lag <= h.horizon), 1.0), 6) AS survival,
  round(sum(CASE WHEN lag >= h.horizon THEN ended ELSE 0 END), 6) AS risk_weight, CAST(sum(CASE WHEN lag >= h.horizon THEN n ELSE 0 END) AS BIGINT) AS risk_rows
FROM curve, (SELECT unnest([30, 90, 180, 365]) AS horizon) h GROUP BY {by} h.horizon"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    rows = joined.select(
        F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), "l_orderkey", "l_linenumber", "l_quantity",
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), lag.alias("lag"),
    )
    return rows.filter("lag >= 0")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"WITH {LINES}, weighted AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY cust) AS weight FROM lines), " + KM.format(by="", part="1"))
def survival_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.balanced_weights(lines(spark, sf_dir), cluster=["cust"])
    out = S.kaplan_meier(rows, time="lag", event=F.col("flag") == "R", weight="weight", horizons=HORIZONS)
    return _rounded(out, "survival", "risk_weight")


@query(f"WITH {LINES}, weighted AS (SELECT *, 1.0::DOUBLE AS weight FROM lines), " + KM.format(by="priority,", part="priority"))
def survival_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("weight", F.lit(1.0))
    out = S.kaplan_meier(rows, time="lag", event=F.col("flag") == "R", weight="weight", horizons=HORIZONS, by=["priority"])
    return _rounded(out, "survival", "risk_weight")


@query(
    f"""WITH RECURSIVE {LINES},
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY cust) AS weight, CASE WHEN flag = 'A' THEN lag // 2 END AS mod,
  CASE WHEN flag = 'R' OR (flag = 'A' AND l_quantity > 25) THEN lag END AS del FROM lines),
k AS (SELECT weight, lag, del, CASE WHEN del IS NULL OR mod < del THEN mod END AS mod FROM w),
each AS (SELECT weight, mod AS t, 'um' AS kind FROM k WHERE mod IS NOT NULL
  UNION ALL SELECT weight, coalesce(del, lag), CASE WHEN del IS NOT NULL THEN CASE WHEN mod IS NOT NULL THEN 'md' ELSE 'ud' END ELSE CASE WHEN mod IS NOT NULL THEN 'mc' ELSE 'uc' END END FROM k),
per AS (SELECT t, sum(CASE WHEN kind = 'um' THEN weight ELSE 0 END) AS um, sum(CASE WHEN kind = 'ud' THEN weight ELSE 0 END) AS ud, sum(CASE WHEN kind = 'md' THEN weight ELSE 0 END) AS md,
  sum(CASE WHEN kind = 'uc' THEN weight ELSE 0 END) AS uc, sum(CASE WHEN kind = 'mc' THEN weight ELSE 0 END) AS mc FROM each GROUP BY t),
risk AS (SELECT *, row_number() OVER (ORDER BY t) AS i, sum(um + ud + uc) OVER () - coalesce(sum(um + ud + uc) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS yu,
  coalesce(sum(um - md - mc) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ym FROM per),
hz AS (SELECT i, t, CASE WHEN yu > 1e-12 THEN um / yu ELSE 0 END AS a, CASE WHEN yu > 1e-12 THEN ud / yu ELSE 0 END AS b, CASE WHEN ym > 1e-12 THEN least(1.0, md / ym) ELSE 0 END AS c FROM risk),
fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS t, 1.0::DOUBLE AS u, 0.0::DOUBLE AS m, 0.0::DOUBLE AS d
  UNION ALL SELECT hz.i, CAST(hz.t AS BIGINT), u * (1 - a - b), m * (1 - c) + u * a, d + u * b + m * c FROM fold JOIN hz ON hz.i = fold.i + 1)
SELECT h.horizon, round(max_by(u, t), 6) AS unchanged, round(max_by(m, t), 6) AS modified, round(max_by(d, t), 6) AS deleted
FROM fold, (SELECT unnest([30, 90, 180, 365]) AS horizon) h WHERE t <= h.horizon GROUP BY h.horizon"""
)
def state_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.balanced_weights(lines(spark, sf_dir), cluster=["cust"])
    modified = F.when(F.col("flag") == "A", F.floor(F.col("lag") / 2))
    deleted = F.when((F.col("flag") == "R") | ((F.col("flag") == "A") & (F.col("l_quantity") > 25)), F.col("lag"))
    rows = rows.withColumn("modified_at", modified).withColumn("deleted_at", deleted)
    out = S.occupancy(rows, modified="modified_at", deleted="deleted_at", censored="lag", weight="weight", horizons=HORIZONS)
    return _rounded(out, "unchanged", "modified", "deleted")


NATIONS = """nations AS (SELECT l.*, c_nationkey AS nation, 1.0::DOUBLE / count(*) OVER (PARTITION BY cust) AS weight FROM lines l JOIN customer ON cust = c_custkey),
clusters AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT nation FROM nations)),
draws AS (SELECT b AS replicate, CAST(('0x' || substr(sha256('boot' || chr(0) || b || chr(0) || place), 1, 12)) AS BIGINT) % n AS place FROM clusters, (SELECT unnest(range(2000)) AS b)),
copies AS (SELECT replicate, nation, count(*) AS copies FROM draws JOIN clusters USING (place) GROUP BY replicate, nation)"""


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the nation of their customer, who weighs as much as any other."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation"))
    return S.balanced_weights(lines(spark, sf_dir), cluster=["cust"]).join(customers, "cust")


@query(
    f"""WITH {LINES}, {NATIONS},
per AS (SELECT replicate, lag, sum(weight * copies) AS ended, sum(CASE WHEN flag = 'R' THEN weight * copies ELSE 0 END) AS died FROM nations JOIN copies USING (nation) GROUP BY replicate, lag),
risk AS (SELECT *, sum(ended) OVER (PARTITION BY replicate ORDER BY lag DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM per),
curve AS (SELECT *, product(1 - died / at_risk) OVER (PARTITION BY replicate ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM risk),
each AS (SELECT replicate, horizon, max_by(s, lag) AS s FROM curve, (SELECT unnest([30, 90, 180, 365]) AS horizon) WHERE lag <= horizon GROUP BY replicate, horizon)
SELECT horizon, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS replicates FROM each GROUP BY horizon"""
)
def survival_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of survival over 2000 resamples of nations."""
    rows = by_nation(spark, sf_dir)
    draws = S.cluster_draws(rows, cluster="nation", replicates=2000, seed="boot")
    out = S.bootstrap_survival(rows, draws, cluster="nation", time="lag", event=F.col("flag") == "R", weight="weight", horizons=HORIZONS)
    return _rounded(out, "low", "high")


@query(
    f"""WITH RECURSIVE {LINES}, {NATIONS},
w AS (SELECT nation, weight, lag, CASE WHEN flag = 'A' THEN lag // 2 END AS mod, CASE WHEN flag = 'R' OR (flag = 'A' AND l_quantity > 25) THEN lag END AS del FROM nations),
k AS (SELECT nation, weight, lag, del, CASE WHEN del IS NULL OR mod < del THEN mod END AS mod FROM w),
each AS (SELECT nation, weight, mod AS t, 'um' AS kind FROM k WHERE mod IS NOT NULL
  UNION ALL SELECT nation, weight, coalesce(del, lag), CASE WHEN del IS NOT NULL THEN CASE WHEN mod IS NOT NULL THEN 'md' ELSE 'ud' END ELSE CASE WHEN mod IS NOT NULL THEN 'mc' ELSE 'uc' END END FROM k),
sums AS (SELECT nation, t, kind, sum(weight) AS w FROM each GROUP BY ALL),
per AS (SELECT replicate AS r, t, sum(CASE WHEN kind = 'um' THEN w * copies ELSE 0 END) AS um, sum(CASE WHEN kind = 'ud' THEN w * copies ELSE 0 END) AS ud, sum(CASE WHEN kind = 'md' THEN w * copies ELSE 0 END) AS md,
  sum(CASE WHEN kind = 'uc' THEN w * copies ELSE 0 END) AS uc, sum(CASE WHEN kind = 'mc' THEN w * copies ELSE 0 END) AS mc FROM sums JOIN copies USING (nation) GROUP BY r, t),
risk AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY t) AS i, sum(um + ud + uc) OVER (PARTITION BY r) - coalesce(sum(um + ud + uc) OVER (PARTITION BY r ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS yu,
  coalesce(sum(um - md - mc) OVER (PARTITION BY r ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ym FROM per),
hz AS MATERIALIZED (SELECT r, i, t, CASE WHEN yu > 1e-12 THEN um / yu ELSE 0 END AS a, CASE WHEN yu > 1e-12 THEN ud / yu ELSE 0 END AS b, CASE WHEN ym > 1e-12 THEN least(1.0, md / ym) ELSE 0 END AS c FROM risk),
fold AS (SELECT CAST(b AS BIGINT) AS r, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS t, 1.0::DOUBLE AS u, 0.0::DOUBLE AS m FROM (SELECT unnest(range(2000)) AS b)
  UNION ALL SELECT hz.r, hz.i, CAST(hz.t AS BIGINT), u * (1 - a - b), m * (1 - c) + u * a FROM fold JOIN hz ON hz.r = fold.r AND hz.i = fold.i + 1),
e AS (SELECT r, h.horizon, max_by(u, t) AS unchanged, max_by(m, t) AS modified FROM fold, (SELECT unnest([30, 90, 180, 365]) AS horizon) h WHERE t <= h.horizon GROUP BY r, h.horizon),
l AS (SELECT horizon, 'unchanged' AS state, unchanged AS share FROM e UNION ALL SELECT horizon, 'modified', modified FROM e UNION ALL SELECT horizon, 'deleted', greatest(0, 1 - unchanged - modified) FROM e)
SELECT horizon, state, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high, count(*) AS replicates FROM l GROUP BY horizon, state"""
)
def occupancy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the shares of unchanged, modified and deleted lines over 2000 resamples of nations."""
    modified = F.when(F.col("flag") == "A", F.floor(F.col("lag") / 2))
    deleted = F.when((F.col("flag") == "R") | ((F.col("flag") == "A") & (F.col("l_quantity") > 25)), F.col("lag"))
    rows = by_nation(spark, sf_dir).withColumn("modified_at", modified).withColumn("deleted_at", deleted)
    draws = S.cluster_draws(rows, cluster="nation", replicates=2000, seed="boot")
    out = S.bootstrap_occupancy(rows, draws, cluster="nation", modified="modified_at", deleted="deleted_at", censored="lag", weight="weight", horizons=HORIZONS)
    return _rounded(out, "low", "high")


STATE = "CASE WHEN flag = 'R' THEN 'deleted' WHEN flag = 'A' THEN 'modified' WHEN status = 'O' THEN 'unobservable' ELSE 'unchanged' END"


@query(
    f"""WITH {LINES}, s AS (SELECT cust, priority, {STATE} AS state FROM lines),
per AS (SELECT priority, cust, count(*) FILTER (state <> 'unobservable') AS seen, count(*) FILTER (state IN ('unchanged', 'modified')) AS alive, count(*) AS n FROM s GROUP BY priority, cust)
SELECT priority, round(avg(CASE WHEN seen > 0 THEN alive / seen END), 6) AS balanced, round(sum(alive) / sum(seen), 6) AS pooled, round(sum(seen) / sum(n), 6) AS coverage, count(*) AS clusters FROM per GROUP BY priority"""
)
def complete_case_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("state", F.expr(STATE))
    out = S.complete_case(rows, cluster=["cust"], by=["priority"], state="state", survived=["unchanged", "modified"], observable=["unchanged", "modified", "deleted"])
    return _rounded(out, "balanced", "pooled", "coverage")


@query(
    """WITH e AS (SELECT user_id, day(ts) AS h, event_type FROM events), t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT user_id, h, k FROM e JOIN t USING (event_type)),
per AS (SELECT user_id, min(CASE WHEN k = 1 AND h % 7 = 0 THEN h END) AS deleted, min(CASE WHEN k = 2 THEN h END) AS modified, min(CASE WHEN k = 3 AND h > 20 THEN h END) AS lost, max(CASE WHEN k > 3 THEN h END) AS seen FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN deleted IS NULL OR modified < deleted THEN modified END AS modified, deleted,
  CASE WHEN deleted IS NOT NULL THEN deleted ELSE coalesce(lost, least(31, coalesce(seen, 31))) END AS censored,
  CASE WHEN deleted IS NOT NULL THEN 'deleted' WHEN lost IS NOT NULL THEN 'lost' ELSE 'cutoff' END AS reason FROM per"""
)
def event_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("h"), "event_type")
    kinds = events.select("event_type").distinct().withColumn("k", F.row_number().over(W.orderBy("event_type")))  # one row a type
    k = F.col("k")
    rows = events.join(F.broadcast(kinds), "event_type").select(
        "user_id", "h",
        F.when(k > 3, "unchanged").otherwise("other").alias("state"),
        F.when((k == 1) & (F.col("h") % 7 == 0), F.col("h")).alias("d"),
        F.when(k == 2, F.col("h")).alias("m"),
        F.when((k == 3) & (F.col("h") > 20), F.col("h")).alias("l"),
    )
    return S.history(rows, key="user_id", horizon="h", state="state", deleted_at="d", modified_at="m", lost_at="l", cutoff=F.lit(31))
