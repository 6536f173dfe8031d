"""Roll-ups, recodes and gates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import templates as T
from sedimenta.functions.hashing import drawn, nul_digest
from sedimenta.functions.identity import utc_instant
from sedimenta.operators import rollups as R
from sedimenta.queries import query, r6, table

STATES = "CASE l_linenumber % 5 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'modified_candidate' WHEN 2 THEN 'deleted' WHEN 3 THEN 'unobservable' ELSE 'modified' END"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    state = F.when(k == 0, "unchanged").when(k == 1, "modified_candidate").when(k == 2, "deleted").when(k == 3, "unobservable").otherwise("modified")
    return table(spark, sf_dir, "lineitem").withColumn("state", state)


@query("SELECT CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = R.merged(F.col("c_mktsegment"), {"HOME": ["HOUSEHOLD", "FURNITURE"]})
    return table(spark, sf_dir, "customer").groupBy(segment.alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE l_orderkey % 50 = 0")
def pruned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.length("l_returnflag").alias("lang_flag"), F.length("l_linestatus").alias("lang_status"))
    return R.without_columns(wide, ["lang"]).filter("l_orderkey % 50 = 0")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'none') AS nones FROM events GROUP BY user_id"""
)
def path_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.kind_counts(table(spark, sf_dir, "events"), by=["user_id"], kind=F.col("event_type"), kinds=["click", "error", "none"])
    return out.select("user_id", F.col("kinds")["click"].alias("clicks"), F.col("kinds")["error"].alias("errors"), F.col("kinds")["none"].alias("nones"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS at FROM events WHERE regexp_matches(props, '\"k\": 7') GROUP BY user_id")
def first_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_matching(table(spark, sf_dir, "events"), by=["user_id"], order=["ts", "event_id"], match=F.col("props").rlike('"k": 7'), value="event_id")


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderdate - INTERVAL 30 DAY >= TIMESTAMP '1997-01-01' AND o_orderdate - INTERVAL 60 DAY >= TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1999-06-01'"""
)
def eligible_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)
    return R.eligible_windows(table(spark, sf_dir, "orders"), at="o_orderdate", clean=30, before=60, after=90, start="1997-01-01", cutoff="1999-06-01", flags=flags).select("o_orderkey")


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE starts_with(o_orderpriority, '1'))"""
)
def safe_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    index = orders.select("c_custkey", F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("dated_"), "o_orderpriority")).otherwise("none").alias("status"))
    return R.safe_controls(table(spark, sf_dir, "customer").select("c_custkey"), orders.filter("o_totalprice > 450000"), index, key="c_custkey", status="status")


@query("SELECT source, count(DISTINCT quality) AS labels FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(DISTINCT quality) > 1")
def conflicting_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicting_labels(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), by="source", label="quality")


@query(
    f"""WITH s AS (SELECT l_suppkey, {STATES} AS state FROM lineitem) SELECT CASE WHEN state = 'modified_candidate' THEN 'modified' ELSE state END AS with_structural, CASE WHEN state = 'modified_candidate' THEN 'unobservable' ELSE state END AS exact_only, count(*) AS n FROM s GROUP BY 1, 2"""
)
def recoded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("state")
    return _states(spark, sf_dir).groupBy(R.recoded(state, structural=True).alias("with_structural"), R.recoded(state, structural=False).alias("exact_only")).agg(F.count("*").alias("n"))


@query("SELECT 'events.[].value' AS path, count(*) AS units FROM (SELECT DISTINCT user_id FROM events)")
def forbidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden fields of nested records, with the units that carry them."""
    units = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.array(F.struct(F.max("event_type").alias("kind"), F.max("value").alias("value"))).alias("events"))
    found = R.forbidden_fields(units.schema, {"value", "outcome"})
    return units.agg(F.count("*").alias("units")).select(F.explode(F.array(*[F.lit(p) for p in found])).alias("path"), "units")


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'not_collected' WHEN 'O' THEN 'unavailable' ELSE o_orderstatus END AS reason, count(*) AS n FROM orders GROUP BY 1")
def final_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderstatus").alias("reason"), F.lit(1).alias("n")).alias("missing"))
    return R.remapped(rows, field="missing.reason", names={"P": "not_collected", "O": "unavailable"}).groupBy("missing.reason").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'PRE' WHEN 1 THEN 'HUMAN_MODERN' WHEN 2 THEN 'SIGNED' WHEN 3 THEN 'OWN' ELSE 'UNSIGNED' END AS p, o_totalprice * (1 + o_orderkey % 5) AS a, ln(o_totalprice + 1) + CASE o_orderkey % 5 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS b, CAST(o_orderkey % 7 AS DOUBLE) AS c FROM orders),
l AS (SELECT 'a' AS f, p, a AS v FROM p UNION ALL SELECT 'b', p, b FROM p UNION ALL SELECT 'c', p, c FROM p),
m AS (SELECT f, avg(v) FILTER (p = 'PRE') AS pre, avg(v) FILTER (p = 'HUMAN_MODERN') AS h, avg(v) FILTER (p = 'SIGNED') AS s, avg(v) FILTER (p = 'OWN') AS o, avg(v) FILTER (p = 'UNSIGNED') AS u, stddev_pop(v) AS sd FROM l GROUP BY f),
e AS (SELECT f, (s - h) / (s - pre) AS ratio, sd, h, u, 'SIGNED' AS agents, s AS m FROM m UNION ALL SELECT f, (s - h) / (s - pre), sd, h, u, 'OWN', o FROM m)
SELECT f AS feature, agents, round(ratio, 6) AS ratio, abs(m - h) < 0.3 * sd AS thin, CASE WHEN abs(m - h) >= 0.3 * sd THEN (u - h) / (m - h) < 0 OR (u - h) / (m - h) > 1 END AS clipped, CASE WHEN abs(m - h) >= 0.3 * sd THEN round(greatest(0, least(1, (u - h) / (m - h))), 6) END AS share FROM e WHERE ratio >= 0.6"""
)
def mixture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "PRE").when(k == 1, "HUMAN_MODERN").when(k == 2, "SIGNED").when(k == 3, "OWN").otherwise("UNSIGNED")
    lift = F.when(k == 2, 3).when(k == 3, 2).when(k == 4, 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(name.alias("p"), (F.col("o_totalprice") * (1 + k)).alias("a"), (F.log(F.col("o_totalprice") + 1) + lift).alias("b"), (F.col("o_orderkey") % 7).cast("double").alias("c"))
    out = R.mixture_table(rows, population="p", features=["a", "b", "c"])
    # a null mean of a missing population can't occur here, so the clipped flag is null only where the gap is thin
    return out.select("feature", "agents", r6(F.col("ratio")).alias("ratio"), "thin", "clipped", F.when(F.col("clipped").isNotNull(), r6(F.col("share"))).alias("share"))


@query(
    """WITH s AS (SELECT c_mktsegment AS stratum, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS signed, sum(o_totalprice) FILTER (o_orderstatus <> 'F') AS unsigned, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS share, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
t AS (SELECT *, CASE WHEN n % 2 = 0 THEN share * 0.8 END AS low, signed > 1000 AS ok FROM s)
SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS strata, round(sum(signed + share * unsigned) FILTER (ok) / sum(signed + unsigned) FILTER (ok), 6) AS share, round(sum(signed + coalesce(low, 0) * unsigned) FILTER (ok) / sum(signed + unsigned) FILTER (ok), 6) AS conservative, round(sum(signed + unsigned) FILTER (ok) / sum(signed + unsigned), 6) AS coverage FROM t"""
)
def identified_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    money, signed = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    per = orders.groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.sum(F.when(signed, money)).alias("signed"), F.sum(F.when(~signed, money)).alias("unsigned"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("share"), F.count("*").alias("n"))
    per = per.withColumn("low", F.when(F.col("n") % 2 == 0, F.col("share") * 0.8).otherwise(float("nan")))
    out = R.identified_total(per, share="share", conservative="low", signed="signed", unsigned="unsigned", identified=F.col("signed") > 1000)
    return out.select("strata", *[r6(F.col(c)).alias(c) for c in ("share", "conservative", "coverage")])


@query(
    """WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'click') AS a, sum(value) FILTER (event_type <> 'click') AS b FROM events GROUP BY user_id) SELECT user_id, round((a + 0.25 * b) / (a + b), 6) AS share FROM s"""
)
def total_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(click, F.col("value"))).alias("a"), F.sum(F.when(~click, F.col("value"))).alias("b"))
    return per.select("user_id", r6(R.total_share(F.lit(0.25), F.col("a"), F.col("b"))).alias("share"))


@query(
    """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS hunks, sum(l_quantity) AS lines FROM lineitem GROUP BY ROLLUP (l_suppkey, l_returnflag)), w AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT g.l_suppkey, l_returnflag, hunks, CAST(lines AS BIGINT) AS lines, q >= 15000 AS substantial FROM g JOIN w ON g.l_suppkey = w.l_suppkey"""
)
def line_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_rollup(table(spark, sf_dir, "lineitem"), unit="l_suppkey", stratum="l_returnflag", lines="l_quantity", substantial=15000).withColumn("lines", F.col("lines").cast("long"))


@query(
    f"""WITH s AS (SELECT l_suppkey, l_orderkey % 4 AS horizon, {STATES} AS state, l_partkey FROM lineitem)
SELECT l_suppkey, horizon, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS deleted, count(DISTINCT l_partkey) AS lines, round(count(*) FILTER (state IN ('unchanged', 'modified', 'deleted')) / count(*), 6) AS coverage FROM s GROUP BY 1, 2"""
)
def state_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).withColumn("horizon", F.col("l_orderkey") % 4)
    names = ["unchanged", "modified", "deleted"]
    return R.state_pivot(rows, by=["l_suppkey"], horizon="horizon", state="state", states=names, line="l_partkey", observable=names)


@query(
    """SELECT c_custkey, count(o_orderkey) AS units, round(coalesce(sum(o_totalprice), 0), 2) AS lines, round(coalesce(sum(o_totalprice * (o_orderkey % 3 + 1)), 0), 2) AS weighted FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey"""
)
def planned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", (F.col("o_orderkey") % 3 + 1).alias("w"))
    out = R.planned_totals(table(spark, sf_dir, "customer"), units, key="c_custkey", lines="o_totalprice", weight="w")
    return out.select("c_custkey", "units", F.round("lines", 2).alias("lines"), F.round("weighted", 2).alias("weighted"))


@query(
    """SELECT 'o_orderpriority' AS field, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2"""
)
def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), columns=["o_orderpriority", "year"], status=F.col("o_orderstatus") == "F")


@query(
    """WITH r AS (SELECT o_orderpriority AS s, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS b FROM orders)
SELECT s, count(*) AS cases, count(*) FILTER (a = b) AS agreed, count(*) FILTER (a = 'unclear' OR b = 'unclear') AS unresolved, round(count(*) FILTER (a = b) / count(*), 6) AS agreement FROM r GROUP BY GROUPING SETS ((), (s))"""
)
def agreement_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = lambda k: F.when(F.col("o_orderkey") % k == 0, "yes").when(F.col("o_orderkey") % k == 1, "no").otherwise("unclear")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("s"), answer(3).alias("a"), answer(4).alias("b"))
    return R.agreement_by(rows, by=["s"], first="a", second="b", unresolved=["unclear"]).withColumn("agreement", r6(F.col("agreement")))


@query(
    """WITH d AS (SELECT l_orderkey, sha256('audit' || chr(0) || l_orderkey || chr(0) || l_linenumber) AS h FROM lineitem) SELECT l_orderkey, count(*) FILTER (CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) % 10000 < 500) AS selected FROM d GROUP BY 1 HAVING count(*) FILTER (CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) % 10000 < 500) > 0"""
)
def selected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = nul_digest(F.lit("audit"), F.col("l_orderkey"), F.col("l_linenumber"))
    return R.exists_selected(table(spark, sf_dir, "lineitem"), task="l_orderkey", selected=drawn(digest, 500))


@query(
    """SELECT f AS name, round(b, 6) AS weight FROM (SELECT p_type AS f, corr(p_size, p_retailprice) AS b FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1) ORDER BY abs(b) DESC, f LIMIT 3"""
)
def strongest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.corr("p_size", "p_retailprice").alias("weight"))
    return R.top_weights(per, name="name", weight="weight", k=3, controls=["ECONOMY"]).select("name", r6(F.col("weight")).alias("weight"))


@query(
    """SELECT l_orderkey, 'l_returnflag' AS field, count(DISTINCT l_returnflag) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 UNION ALL SELECT l_orderkey, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1"""
)
def inconsistent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inconsistent(table(spark, sf_dir, "lineitem"), by=["l_orderkey"], columns=["l_returnflag", "l_linestatus"])


@query(
    """SELECT o_custkey, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')), ','), '') AS never, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'O')), ','), '') AS not_yet FROM orders GROUP BY 1"""
)
def control_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.control_roles(table(spark, sf_dir, "orders"), by="o_custkey", control="o_orderkey", role="o_orderstatus", roles={"F": "never", "O": "not_yet"})
    return out.select("o_custkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("never", "not_yet")])


@query(
    """WITH c AS (SELECT c_mktsegment AS s, c_acctbal / 1000 AS e, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 5000 END AS p, c_custkey % 3 AS m, c_nationkey AS k FROM customer),
g AS (SELECT s, CAST(sum(m) AS BIGINT) AS adopters, max(k) AS controls, sum(e * m) / sum(m) AS effect, sum(p * m) / sum(CASE WHEN p IS NOT NULL THEN m END) AS pretrend FROM c GROUP BY s)
SELECT s, adopters, controls, CASE WHEN adopters >= 300 AND controls >= 20 THEN round(effect, 6) END AS effect, CASE WHEN adopters >= 300 AND controls >= 20 THEN round(pretrend, 6) END AS pretrend, CASE WHEN adopters < 300 THEN 'fewer than 300 adopters' ELSE '' END AS reasons FROM g"""
)
def gated_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, money = F.col("c_custkey"), F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s"), (money / 1000).alias("e"), F.when(key % 4 > 0, money / 5000).alias("p"), (key % 3).alias("m"), "c_nationkey")
    out = R.gated_effects(rows, by=["s"], effect="e", pretrend="p", copies="m", controls=F.col("c_nationkey"), least_adopters=300, least_controls=20)
    return out.select("s", "adopters", "controls", r6(F.col("effect")).alias("effect"), r6(F.col("pretrend")).alias("pretrend"), F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS a, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, concat_ws(',', CASE WHEN NOT a >= 4500 THEN 'auc' END, CASE WHEN NOT n >= 60 THEN 'size' END) AS failed, a >= 4500 AND n >= 60 AS identified FROM g"""
)
def identification_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    return R.all_gates(per, {"auc": F.col("a") >= 4500, "size": F.col("n") >= 60}).select("c_nationkey", F.array_join("failed", ",").alias("failed"), "identified")


@query(
    """WITH p AS (SELECT l_returnflag, l_linestatus, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, count(*) FILTER (q >= 2500) AS groups, count(*) FILTER (q >= 2500) >= 40 AS passed FROM p GROUP BY 1, 2"""
)
def diversity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diversity_gates(table(spark, sf_dir, "lineitem"), by=["l_returnflag", "l_linestatus"], group="l_suppkey", lines="l_quantity", substantial=2500, least=40)


@query(
    """WITH p AS (SELECT DISTINCT user_id, CAST(d AS TIMESTAMP) AS at FROM events, (SELECT unnest([DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22']) AS d)),
t AS (SELECT p.user_id, p.at, arg_max(event_type, (ts, event_type)) AS s FROM p JOIN (SELECT user_id, ts, max(event_type) AS event_type FROM events WHERE value > 30 GROUP BY 1, 2) e ON e.user_id = p.user_id AND e.ts < p.at GROUP BY 1, 2)
SELECT p.user_id, p.at, coalesce(t.s, 'unchanged') AS state FROM p LEFT JOIN t ON t.user_id = p.user_id AND t.at = p.at"""
)
def states_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = events.schema["ts"].dataType
    days = F.array(*[F.lit(d).cast(kind) for d in ("2024-01-08", "2024-01-15", "2024-01-22")])
    moves = events.filter("value > 30").groupBy("user_id", "ts").agg(F.max("event_type").alias("state"))
    points = events.select("user_id").distinct().withColumn("at", F.explode(days))
    return R.state_before(moves, points, key="user_id", at="ts", state="state", time="at")


@query(
    """WITH w AS (SELECT o_orderkey, o_orderdate, unnest([30, 90, 180, 365]) AS horizon FROM orders WHERE o_custkey % 20 = 0), s AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 30 WHEN 2 THEN 90 WHEN 3 THEN 180 ELSE 365 END AS horizon, max(l_returnflag) AS state FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, w.horizon, coalesce(state, 'missing') AS state, o_orderdate + to_days(w.horizon) AS target FROM w LEFT JOIN s ON s.l_orderkey = w.o_orderkey AND s.horizon = w.horizon"""
)
def horizon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    states = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.when(n == 1, 30).when(n == 2, 90).when(n == 3, 180).otherwise(365).alias("horizon")).agg(F.max("l_returnflag").alias("state"))
    lines = table(spark, sf_dir, "orders").filter("o_custkey % 20 = 0")
    return R.horizon_rows(lines, states, key="o_orderkey", horizons=[30, 90, 180, 365], start="o_orderdate").select("o_orderkey", "horizon", "state", "target")


@query(
    """SELECT o_custkey, count(*) AS keys, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS found, count(*) = count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS whole FROM orders GROUP BY 1"""
)
def covered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.covered(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), key="o_orderkey", by="o_custkey")


@query(
    """WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1)
(SELECT *, 'stored' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) UNION ALL (SELECT *, 'recomputed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))"""
)
def recomputed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    stored = again.withColumn("n", F.col("n") + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0))
    return R.recomputed(stored, again)


@query(
    """WITH p AS (SELECT count(*) AS regions, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) * 5 AS planned FROM region) SELECT 'regions' AS field, CAST(regions AS VARCHAR) AS value, '6' AS frozen FROM p WHERE regions <> 6 UNION ALL SELECT 'nations', CAST(nations AS VARCHAR), '25' FROM p WHERE nations <> 25"""
)
def frozen_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    protocol = table(spark, sf_dir, "region").agg(F.count("*").alias("regions")).join(table(spark, sf_dir, "nation").agg(F.count("*").alias("nations")))
    return R.frozen_violations(protocol, {"regions": 6, "nations": 25})


@query(
    r"""SELECT page_id, 'repo:^' || regexp_replace(url, '([\\.^$|?*+()\[\]{}\-])', '\\\1', 'g') || '$ rev:' || page_id AS query, regexp_replace(url, 'page=\d+', 'page=99') AS moved FROM pages WHERE len(regexp_extract_all(url, 'page=\d+')) = 1
UNION ALL SELECT page_id, 'repo:^' || regexp_replace(url, '([\\.^$|?*+()\[\]{}\-])', '\\\1', 'g') || '$ rev:' || page_id, NULL FROM pages WHERE len(regexp_extract_all(url, 'page=\d+')) <> 1"""
)
def rendered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.rendered(F.lit("repo:^{name}$ rev:{commit}"), name=T.escaped(F.col("url")), commit=F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("query"), T.replaced_once(F.col("url"), r"page=\d+", F.lit("page=99")).alias("moved"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", utc_instant(F.col("ts")).alias("at"))
