"""Summaries and contracts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import contracts as C
from sedimenta.operators import summaries as Z
from sedimenta.queries import query, r6, table


@query(
    """WITH p AS (SELECT CASE WHEN o_orderstatus = 'F' AND d >= '1998-01-01' THEN 'signed' WHEN d >= '1998-01-01' THEN 'unsigned' WHEN d < '1997-01-01' THEN 'pre' END AS population, o_totalprice FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders))
SELECT population, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM p GROUP BY population"""
)
def named_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date").cast("string"))
    out = Z.populations(orders, agent=F.col("o_orderstatus") == "F", date="d", modern="1998-01-01", old="1997-01-01")
    return out.groupBy("population").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    """SELECT event_type, t AS threshold, count(*) AS rows, count(*) FILTER (value >= t) AS hits, round(count(*) FILTER (value >= t) / count(*), 6) AS row_share, round(sum(CASE WHEN value >= t THEN value ELSE 0 END) / sum(value), 6) AS amount_share
FROM events, (SELECT unnest([3.0::DOUBLE, 4.0::DOUBLE, 50.0::DOUBLE]) AS t) GROUP BY event_type, t"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Z.threshold_sweep(table(spark, sf_dir, "events"), by=["event_type"], score="value", amount="value", thresholds=[3.0, 4.0, 50.0])
    return out.select("event_type", "threshold", "rows", "hits", r6(F.col("row_share")).alias("row_share"), r6(F.col("amount_share")).alias("amount_share"))


@query(
    """WITH t AS (SELECT user_id, min(ts) AS turn FROM events WHERE value > 80 GROUP BY user_id),
s AS (SELECT e.user_id, count(*) FILTER (ts < turn) AS n0, count(*) FILTER (ts >= turn) AS n1, count(*) FILTER (ts < turn AND value > 50) AS h0, count(*) FILTER (ts >= turn AND value > 50) AS h1 FROM events e JOIN t ON e.user_id = t.user_id GROUP BY e.user_id)
SELECT user_id, round(CASE WHEN n0 > 0 THEN h0 / n0 END, 6) AS before, round(CASE WHEN n1 > 0 THEN h1 / n1 END, 6) AS after, round(CASE WHEN n0 > 0 AND n1 > 0 THEN h1 / n1 - h0 / n0 END, 6) AS change FROM s"""
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    turns = events.filter("value > 80").groupBy("user_id").agg(F.min("ts").alias("turn"))
    out = Z.before_after(events.join(turns, "user_id"), by=["user_id"], at="ts", turn="turn", hit=F.col("value") > 50)
    return out.select("user_id", *[r6(F.col(c)).alias(c) for c in ("before", "after", "change")])


@query(
    """WITH s AS (SELECT user_id, ts AS lo, ts + INTERVAL 2 DAY AS hi, event_type AS label FROM events WHERE value > 60)
SELECT e.event_id, coalesce(min(s.label), 'none') AS label FROM events e LEFT JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.lo AND s.hi GROUP BY e.event_id"""
)
def labels_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    spans = events.filter("value > 60").select("user_id", F.col("ts").alias("lo"), F.expr("ts + interval 2 days").alias("hi"), F.col("event_type").alias("label"))
    return Z.valid_labels(events.select("event_id", "user_id", "ts"), spans, key="user_id", at="ts", start="lo", end="hi", label="label", none="none").select("event_id", "label")


@query(
    r"""WITH h AS (SELECT source, doc_id, unnest(range(len(q))) AS i, unnest(q) AS quote FROM (SELECT source, doc_id, regexp_extract_all(text, '[Ll]icensed[^\n]*') AS q FROM documents)),
r AS (SELECT source, quote, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS INTEGER) AS rank FROM h)
SELECT source, rank, substr(quote, 1, 240) AS quote FROM r WHERE rank <= 3"""
)
def policy_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.first_quotes(table(spark, sf_dir, "documents"), by="source", order="doc_id", text="text", pattern=r"[Ll]icensed[^\n]*")


@query(
    """SELECT source, CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN n_chars > 8000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2"""
)
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("n_chars") < 100, "short").when(F.col("lang") != "en", "language").when(F.col("n_chars") > 8000, "long")
    return Z.exclusion_counts(table(spark, sf_dir, "documents"), by=["source"], reason=reason)


@query(
    """WITH d AS (SELECT user_id, day(ts) AS p, event_type AS f, max(value) AS v FROM events GROUP BY 1, 2, 3), w AS (SELECT user_id, p, max(v) FILTER (f = 'click') AS click, max(v) FILTER (f = 'view') AS view FROM d GROUP BY 1, 2),
c AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS lo, max(p) OVER (PARTITION BY user_id) AS hi FROM w WHERE click IS NOT NULL AND view IS NOT NULL) SELECT user_id, CAST(p AS INTEGER) AS p, click, view FROM c WHERE p = lo OR p = hi"""
)
def complete_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("p"), F.col("event_type").alias("f")).agg(F.max("value").alias("v"))
    return Z.complete_panel(rows, unit="user_id", period="p", feature="f", value="v", features=["click", "view"])


@query(
    """WITH r AS (SELECT o_custkey, max(o_orderstatus) FILTER (o_orderkey % 3 = 0) AS p, max(o_orderstatus) FILTER (o_orderkey % 3 = 1) AS s, max(o_orderstatus) FILTER (o_orderkey % 3 = 2) AS r FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN p = s THEN p ELSE r END AS decision, CASE WHEN p = s THEN 'primary_agreement' WHEN r IS NOT NULL THEN 'resolution' ELSE 'pending' END AS basis FROM r"""
)
def final_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("o_orderkey") % 3 == 0, "primary").when(F.col("o_orderkey") % 3 == 1, "secondary").otherwise("resolution")
    return Z.final_decisions(table(spark, sf_dir, "orders").withColumn("stage", stage), case="o_custkey", stage="stage", decision="o_orderstatus")


@query(
    """WITH l AS (SELECT l_suppkey, l_partkey % 100 + 1 AS k FROM lineitem WHERE l_quantity > 48), c AS (SELECT DISTINCT l.l_suppkey, s.s_suppkey AS canonical FROM l JOIN supplier s ON s.s_suppkey = l.k WHERE s.s_suppkey <> l.l_suppkey)
SELECT a.l_suppkey, count(c.canonical) AS n, min(c.canonical) AS first FROM (SELECT DISTINCT l_suppkey FROM l) a LEFT JOIN c ON a.l_suppkey = c.l_suppkey GROUP BY a.l_suppkey"""
)
def control_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select("l_suppkey", F.array(F.col("l_partkey") % 100 + 1).alias("names"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("canonical"))
    return Z.citations(rows, names, citing="l_suppkey", cited="names", name="name", canonical="canonical")


@query(
    """WITH a AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag <> 'R') AS g, count(*) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag <> 'R') AS g, count(*) AS s FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
SELECT count(*) AS pairs, round(avg(a.g / a.s - b.g / b.s), 6) AS balanced, round(sum(a.g) / sum(a.s) - sum(b.g) / sum(b.s), 6) AS pooled FROM a JOIN b ON a.k = b.k"""
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    side = lambda c: lines.filter(c).groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") != "R").alias("g"), F.count("*").alias("s"))
    out = Z.paired_difference(side("l_linenumber <= 3"), side("l_linenumber > 3"), key="k", good="g", seen="s")
    return out.select("pairs", r6(F.col("balanced")).alias("balanced"), r6(F.col("pooled")).alias("pooled"))


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_totalprice > 5000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status' END, CASE WHEN NOT coalesce(o_orderdate < TIMESTAMP '1998-06-01', false) THEN 'date' END) AS errors
FROM orders WHERE NOT (coalesce(o_totalprice > 5000, false) AND coalesce(o_orderstatus IN ('F', 'O'), false) AND coalesce(o_orderdate < TIMESTAMP '1998-06-01', false))"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"price": F.col("o_totalprice") > 5000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")}
    return C.violations(table(spark, sf_dir, "orders"), key=["o_orderkey"], rules=rules).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def balance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
