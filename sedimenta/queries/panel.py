"""Panels of customers by quarter; a customer adopts with its first large order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.dates import quarter_index
from sedimenta.operators import matching as M
from sedimenta.operators import panel as D
from sedimenta.operators.classify import fit_logit, out_of_fold
from sedimenta.operators.quantify import weighted_auc
from sedimenta.queries import query, r6, table

PANEL = """panel AS (SELECT o_custkey AS cust, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
adopters AS (SELECT c_custkey AS cust, c_mktsegment AS seg, (SELECT min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AS adopted FROM customer)"""
EFFECTS = f"""{PANEL},
tr AS (SELECT a.cust, a.seg, a.adopted - 1 AS pre, a.adopted + 1 AS post, p1.v - p0.v AS change FROM adopters a JOIN panel p0 ON p0.cust = a.cust AND p0.q = a.adopted - 1 JOIN panel p1 ON p1.cust = a.cust AND p1.q = a.adopted + 1),
w AS (SELECT DISTINCT seg, adopted - 1 AS pre, adopted + 1 AS post FROM adopters WHERE adopted IS NOT NULL),
ct AS (SELECT w.seg, w.pre, w.post, avg(p1.v - p0.v) AS control_change, count(*) AS controls FROM w JOIN adopters a ON a.seg = w.seg AND (a.adopted IS NULL OR a.adopted > w.post) JOIN panel p0 ON p0.cust = a.cust AND p0.q = w.pre JOIN panel p1 ON p1.cust = a.cust AND p1.q = w.post GROUP BY 1, 2, 3),
eff AS (SELECT tr.cust, tr.seg, tr.pre, tr.post, change, control_change, controls, change - control_change AS effect FROM tr JOIN ct ON tr.seg = ct.seg AND tr.pre = ct.pre AND tr.post = ct.post)"""


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), quarter_index(F.col("o_orderdate")).alias("q"), "o_totalprice")
    panel = orders.groupBy("cust", "q").agg(F.avg("o_totalprice").alias("v"))
    first = orders.filter("o_totalprice > 350000").groupBy("cust").agg(F.min("q").alias("adopted"))
    adopters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("seg")).join(first, "cust", "left")
    return D.contrasts(panel, adopters, unit="cust", period="q", value="v", stratum="seg")


@query(f"WITH {EFFECTS} SELECT cust, seg, pre, post, round(change, 6) AS change, round(control_change, 6) AS control_change, controls, round(effect, 6) AS effect FROM eff")
def adoption_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contrasts(spark, sf_dir)
    return out.select("cust", "seg", *[F.col(c).cast("long").alias(c) for c in ("pre", "post")], F.round("change", 6).alias("change"), F.round("control_change", 6).alias("control_change"), "controls", F.round("effect", 6).alias("effect"))


@query(f"WITH {EFFECTS} SELECT seg, count(*) AS n, round(avg(effect), 4) AS mean, round(CASE WHEN count(*) > 1 THEN avg(effect) / sqrt(var_samp(effect) / count(*)) END, 6) AS t FROM eff GROUP BY seg")
def adoption_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.mean_test(contrasts(spark, sf_dir), by=["seg"], value="effect")
    return out.select("seg", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), r6(F.col("t")).alias("t"))


@query(
    """WITH c AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS f1, (SELECT coalesce(sum(o_totalprice), 0) FROM orders WHERE o_custkey = c_custkey) AS f2 FROM customer),
s AS (SELECT seg, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2 FROM c GROUP BY seg),
p AS (SELECT a.c_custkey AS adopter, b.c_custkey AS control, round(pow((a.f1 - b.f1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END, 2) + pow((a.f2 - b.f2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END, 2), 12) AS distance
  FROM c a JOIN s ON a.seg = s.seg JOIN c b ON b.seg = a.seg WHERE a.c_custkey % 10 = 0 AND b.c_custkey % 10 <> 0),
r AS (SELECT adopter, control, distance, CAST(row_number() OVER (PARTITION BY adopter ORDER BY distance, control) AS INTEGER) AS rank FROM p)
SELECT adopter, control, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5"""
)
def nearest_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("f2"))
    units = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("f1")).join(totals, "c_custkey", "left").fillna(0.0, ["f2"])
    out = D.nearest_controls(units.filter("c_custkey % 10 = 0"), units.filter("c_custkey % 10 <> 0"), unit="c_custkey", stratum="seg", features=["f1", "f2"])
    return out.select("adopter", "control", r6(F.col("distance")).alias("distance"), "rank")


@query(
    """WITH m AS (SELECT o_orderpriority AS p, o_orderstatus = 'F' AS side, sum(w) AS w, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2) AS var
  FROM (SELECT *, o_totalprice / 1000 AS v, 1.0 + o_orderkey % 3 AS w FROM orders) GROUP BY 1, 2)
SELECT a.p AS o_orderpriority, round((a.mean - b.mean) / sqrt((a.var + b.var) / 2), 6) AS shift FROM m a JOIN m b ON a.p = b.p WHERE a.side AND NOT b.side"""
)
def era_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") / 1000)
    out = D.mean_shift(rows, by=["o_orderpriority"], side=F.col("o_orderstatus") == "F", value="v", weight=F.lit(1.0) + F.col("o_orderkey") % 3)
    return out.select("o_orderpriority", r6(F.col("shift")).alias("shift"))


@query(
    """WITH p AS (SELECT year(o_orderdate) AS y, sum(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END) / count(*) AS r, count(*) AS w FROM orders GROUP BY 1 HAVING count(*) >= 100), k AS (SELECT *, row_number() OVER (ORDER BY y DESC) AS k FROM p)
SELECT count(*) AS periods, round(least(0.95, greatest(regr_intercept(r, y) + regr_slope(r, y) * 2001, avg(r) FILTER (k <= 3))), 6) AS rate FROM k"""
)
def drift_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    out = D.trend_ceiling(rows, period="y", rate=F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0), weight=F.lit(1.0), target=2001, least=100)
    return out.select("periods", r6(F.col("rate")).alias("rate"))


@query()
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders matched one to one to open ones of the same customer, within 90 days and a factor 2."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    pairs = M.caliper_pairs(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"), block=["o_custkey"], at="o_orderdate", size="o_totalprice", days=90, ratio=2)
    key = F.sha2(F.col("target.o_orderkey").cast("string").cast("binary"), 256)
    return M.greedy(pairs, block=["o_custkey"], target=F.col("target.o_orderkey"), candidate=F.col("candidate.o_orderkey"), order=key, cost=[F.col("gap"), F.col("size_ratio")])


@query()
def returned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of returned and other lines under a ridge logistic fit, by return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    model = fit_logit(rows, features=["l_quantity", "l_discount", "l_extendedprice"], label=F.col("l_returnflag") == "R", weight=F.lit(1.0))
    return rows.withColumn("score", model.score()).groupBy("l_returnflag").agg(r6(F.avg("score")).alias("score"), F.count("*").alias("n"))


@query()
def held_out_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by line status: returned lines scored by models that never saw their supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice", (F.col("l_suppkey") % 3).cast("int").alias("fold"))
    scored = out_of_fold(rows, fold="fold", k=3, features=["l_quantity", "l_discount", "l_extendedprice"], label=F.col("l_returnflag") == "R", weight=F.lit(1.0))
    return weighted_auc(scored, score="score", label=F.col("l_returnflag") == "R", weight=F.lit(1.0), by=["l_linestatus"]).withColumn("auc", r6(F.col("auc")))
