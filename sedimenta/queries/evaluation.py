"""Evaluation of scores over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import evaluation as E
from sedimenta.operators import order, quantification, refit
from sedimenta.operators.classify import fit_logit
from sedimenta.operators.quantify import group_rates
from sedimenta.queries import query, r6, table

FEATURES = ["l_quantity", "l_discount", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate", *FEATURES).withColumn("group", F.col("l_suppkey") % 10)


@query()
def left_out_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of each of three groups of suppliers under a fit on all others."""
    out = E.left_out_groups(_lines(spark, sf_dir), group="group", groups=[0, 1, 2], features=FEATURES, label=F.col("l_returnflag") == "R")
    return out.withColumn("auc", r6(F.col("auc")))


@query()
def era_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC on late shipments of a fit on early ones."""
    out = E.era_holdout(_lines(spark, sf_dir), late=F.year("l_shipdate") >= 1997, features=FEATURES, label=F.col("l_returnflag") == "R")
    return out.withColumn("auc", r6(F.col("auc")))


@query()
def fits_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for each line status with its rates and gate."""
    out = E.fits_by_stratum(_lines(spark, sf_dir), stratum="l_linestatus", features=FEATURES, label=F.col("l_returnflag") == "R", weight=F.col("l_quantity"))
    return out.select("l_linestatus", "positive", "negative", *[r6(F.col(c)).alias(c) for c in ("auc", "tpr", "fpr")], "reason")


@query()
def cross_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rate of shipped lines, by supplier, under a model of the others; suppliers of little weight are left out."""
    rows = _lines(spark, sf_dir)
    model = fit_logit(rows.filter("l_linestatus = 'O'"), features=FEATURES, label=F.col("l_returnflag") == "R", weight=F.col("l_quantity"))
    scored = rows.filter("l_linestatus = 'F'").withColumn("score", model.score())
    return group_rates(scored, by=["l_suppkey"], hit=F.col("score") >= 0.33, weight=F.col("l_quantity"), least=2000.0).select("l_suppkey", r6(F.col("rate")).alias("rate"), "saturated")


@query(
    """WITH r AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 150000) / count(*) FILTER (o_orderstatus = 'F') AS tpr, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 250000) / count(*) FILTER (o_orderstatus = 'P') AS fpr FROM orders GROUP BY 1),
g AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, o_custkey % 40 AS g, sum(o_totalprice) AS l, sum(CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE 0 END) AS h FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2, 3),
c AS (SELECT p, y, count(*) AS groups, sum(h) / sum(l) AS a, avg(h / l) AS b FROM g GROUP BY 1, 2), u AS (SELECT p, y, groups, 'line' AS weighting, a AS observed FROM c UNION ALL SELECT p, y, groups, 'repository', b FROM c),
s AS (SELECT u.*, tpr, fpr, CASE WHEN groups < 30 THEN 'too_few_groups' WHEN tpr - fpr < 0.05 THEN 'rates_too_near' ELSE 'identified' END AS status FROM u JOIN r ON u.p = r.p)
SELECT p, y, weighting, groups, round(observed, 6) AS observed, status, CASE WHEN status = 'identified' THEN round(greatest(0, least(1, (observed - fpr) / (tpr - fpr))), 6) END AS share FROM s"""
)
def prevalence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 40).alias("g"), "o_totalprice", "o_orderstatus")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    share = lambda s, least: F.count_if((status == s) & (price > least)) / F.count_if(status == s)
    rates = orders.groupBy("p").agg(share("F", 150000).alias("tpr"), share("P", 250000).alias("fpr"))
    out = E.prevalence_grid(orders.filter("o_orderstatus = 'O'"), rates, by=["p", "y"], group="g", lines="o_totalprice", hit=price > 200000, on="p", least_groups=30)
    return out.select("p", "y", "weighting", "groups", r6(F.col("observed")).alias("observed"), "status", r6(F.col("share")).alias("share"))


@query("SELECT DISTINCT sha256(l_returnflag || '|' || l_linestatus || '|' || l_partkey) AS content_sha256 FROM lineitem WHERE l_suppkey % 2 = 0")
def target_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").filter("l_suppkey % 2 = 0").select(F.sha2(text.cast("binary"), 256).alias("content_sha256")).distinct()


@query("SELECT c_mktsegment AS role, c_nationkey % 3 AS tier, count(*) AS units, count(*) FILTER (c_acctbal < 0) AS invalid, round(sum(greatest(c_acctbal, 0)), 2) AS lines FROM customer GROUP BY 1, 2")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("role"), (F.col("c_nationkey") % 3).alias("tier"))
    return role.agg(F.count("*").alias("units"), F.count_if(F.col("c_acctbal") < 0).alias("invalid"), F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("lines"))


def _dear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a label that their price tells in part: the rest is a digest of the key."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    noise = F.crc32(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).cast("binary")) % 40000
    return lines.withColumn("dear", (F.col("l_extendedprice") + noise > 70000).cast("int")).drop("l_orderkey", "l_linenumber")


@query()
def refit_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of dear lines of half of the suppliers, every model refitted on each of 200 resamples of suppliers."""
    lines = _dear(spark, sf_dir)
    reference, target = lines.filter("l_suppkey % 2 = 0"), lines.filter("l_suppkey % 2 = 1")
    draws = order.stratified_draws(reference, unit="l_suppkey", strata=["dear"], replicates=200, seed="refit", folds=5)
    goal = order.stratified_draws(target, unit="l_suppkey", strata=[], replicates=200, seed="target")
    shares = refit.refit_shares(reference, target, draws, goal, group="l_suppkey", features=["l_extendedprice", "l_discount", "l_tax"], label="dear", weight="l_quantity", replicates=200)
    return refit.refit_interval(shares).select("replicates", "successful", "failed", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    """WITH u AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)),
d AS (SELECT c_mktsegment, replicate, place % 5 AS fold, CAST(('0x' || substr(sha256('era' || chr(0) || c_mktsegment || chr(0) || replicate || chr(0) || place), 1, 12)) AS BIGINT) % n AS place FROM u, (SELECT unnest(range(2000)) AS replicate))
SELECT d.c_mktsegment, c_nationkey, fold, count(*) AS draws, count(DISTINCT replicate) AS replicates FROM d JOIN u ON u.c_mktsegment = d.c_mktsegment AND u.place = d.place GROUP BY ALL"""
)
def drawn_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each nation of a market segment is drawn in each fold of 2000 resamples; segments keep their sizes."""
    draws = order.stratified_draws(table(spark, sf_dir, "customer"), unit="c_nationkey", strata=["c_mktsegment"], replicates=2000, seed="era", folds=5)
    return draws.groupBy("c_mktsegment", "c_nationkey", "fold").agg(F.sum("copies").alias("draws"), F.count_distinct("replicate").alias("replicates"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate, o_custkey, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS d, lag(o_custkey) OVER (ORDER BY o_orderkey) AS c FROM orders)
SELECT o_orderkey, o_orderdate, o_custkey, o_orderdate = d AND o_custkey = c AS same FROM o WHERE d IS NOT NULL AND NOT (o_orderdate > d OR o_orderdate = d AND o_custkey > c)"""
)
def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that, by key, come after one of a later date and customer."""
    return order.order_violations(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), sequence="o_orderkey", keys=["o_orderdate", "o_custkey"])


def _quantified(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    lines = _dear(spark, sf_dir)
    scored = quantification.crossfit(lines.filter("l_suppkey % 2 = 0"), lines.filter("l_suppkey % 2 = 1"), group="l_suppkey", features=["l_extendedprice", "l_discount", "l_tax"], label="dear", weight="l_quantity", kind=kind)
    return quantification.quantified(*scored, group="l_suppkey", label="dear", weight="l_quantity")


def _rounded(point: DataFrame) -> DataFrame:
    return point.select(*[r6(F.col(c)).alias(c) for c in ("share", "adjusted", "disagreement", "misfit", "auc", "threshold")], "auc_passed", "mixture_passed", "agreement_passed", "identified")


@query()
def quantified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dear lines of half of the suppliers by cross-fitted logistic scores, with its gates."""
    return _rounded(_quantified(spark, sf_dir, "logistic")["point"])


@query()
def challenger_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by boosted trees."""
    return _rounded(_quantified(spark, sf_dir, "trees")["point"])


@query()
def omitted_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share without each target supplier, and how far it moves."""
    return _quantified(spark, sf_dir, "logistic")["omitted"].select("l_suppkey", r6(F.col("share")).alias("share"), r6(F.col("shift")).alias("shift"))


@query()
def mixture_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture shares by language and tier of documents, by both weightings, with intervals over 2000 resamples of sources."""
    docs = table(spark, sf_dir, "documents").withColumn("score", r6(F.col("n_chars") % 997 / F.lit(997.0)))
    high = F.col("doc_id") % 3 == 1
    sided = docs.select("lang", "source", (F.col("doc_id") % 2).alias("tier"), (F.col("doc_id") % 3).alias("part"), high.cast("int").alias("y"), F.when(high | (F.col("doc_id") % 6 == 0), F.sqrt("score")).otherwise(F.pow("score", 2)).alias("score"), F.lit(1.0).alias("w"))
    reference, target = sided.filter("part <> 0"), sided.filter("part = 0")
    draws = order.stratified_draws(target, unit="source", strata=[], replicates=2000, seed="cells")
    out = quantification.mixture_grid(reference, target, draws, stratum="lang", by=["tier"], group="source", label="y", weight="w")
    return out.select("lang", "tier", "weighting", "groups", *[r6(F.col(c)).alias(c) for c in ("share", "low", "high", "misfit")], "replicates", "status")


@query()
def validated_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well known shares are found again in mixtures of suppliers that the model has not seen, with the coverage of intervals."""
    lines = _dear(spark, sf_dir).filter(F.col("l_quantity") > 0)
    # a validation group is a supplier's lines of one label
    held = lines.filter("l_suppkey % 2 = 1").withColumn("l_suppkey", F.col("l_suppkey") * 2 + F.col("dear") + 1000000)
    features = ["l_extendedprice", "l_discount", "l_tax"]
    out = quantification.dedicated_validation(lines.filter("l_suppkey % 2 = 0"), held, group="l_suppkey", features=features, label="dear", weight="l_quantity", shares=[0.1, 0.5, 0.9], trials=200, picks=8, replicates=200, seed="validation")
    return out.select("share", *[r6(F.col(c)).alias(c) for c in ("error", "worst", "bias", "coverage")], "trials")
