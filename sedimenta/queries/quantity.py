"""Scores and labels: labelled documents scored by length, with their source as the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.stats import adjusted_share, nearest_rank, sample_deviation, weighted_mean, weighted_rate
from sedimenta.operators import quantify as K
from sedimenta.queries import query, r6, table

SCORED = """scored AS (SELECT d.doc_id, source, lang, quality, toxic, (n_chars % 997) / 997.0::DOUBLE AS score, 1.0 + d.doc_id % 3 AS weight FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SIDES = """sided AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'target' WHEN doc_id % 3 = 1 THEN 'agent' ELSE 'human' END AS side, source, 1.0::DOUBLE AS weight,
  CASE WHEN doc_id % 3 = 1 OR (doc_id % 3 = 0 AND doc_id % 2 = 0) THEN sqrt((n_chars % 997) / 997.0::DOUBLE) ELSE pow((n_chars % 997) / 997.0::DOUBLE, 2) END AS score FROM documents)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "source", "lang", "quality", "toxic", (F.col("n_chars") % 997 / F.lit(997.0)).alias("score"), (F.lit(1.0) + F.col("doc_id") % 3).alias("weight"))


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, x = table(spark, sf_dir, "documents"), F.col("n_chars") % 997 / F.lit(997.0)
    side = F.when(F.col("doc_id") % 3 == 0, "target").when(F.col("doc_id") % 3 == 1, "agent").otherwise("human")
    high = (F.col("doc_id") % 3 == 1) | ((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 2 == 0))
    return docs.select(side.alias("side"), "source", F.lit(1.0).alias("weight"), F.when(high, F.sqrt(x)).otherwise(F.pow(x, 2)).alias("score"))


@query(
    f"""WITH {SCORED} SELECT a.lang, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.weight * b.weight) / sum(a.weight * b.weight), 6) AS auc
FROM scored a JOIN scored b ON a.lang = b.lang WHERE a.quality = 1 AND b.quality <> 1 GROUP BY a.lang"""
)
def weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.weighted_auc(scored(spark, sf_dir), score="score", label=F.col("quality") == 1, weight=F.col("weight"), by=["lang"])
    return out.filter("auc is not null").select("lang", r6(F.col("auc")).alias("auc"))


@query(
    f"""WITH {SCORED} SELECT lang, round(sum(CASE WHEN quality = 1 AND score >= 0.5 THEN weight ELSE 0 END) / sum(weight) FILTER (quality = 1), 6) AS tpr, round(sum(CASE WHEN quality <> 1 AND score >= 0.5 THEN weight ELSE 0 END) / sum(weight) FILTER (quality <> 1), 6) AS fpr FROM scored GROUP BY lang"""
)
def rates_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.rates_at(scored(spark, sf_dir), score="score", label=F.col("quality") == 1, weight=F.col("weight"), threshold=F.lit(0.5), by=["lang"])
    return out.select("lang", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


@query(
    f"""WITH {SCORED}, c AS (SELECT DISTINCT unnest(quantile_cont(score, list_transform(range(1, 50), lambda i: i * 0.02))) AS threshold FROM scored),
r AS (SELECT threshold, sum(weight) FILTER (quality = 1 AND score >= threshold) / sum(weight) FILTER (quality = 1) AS tpr, coalesce(sum(weight) FILTER (quality <> 1 AND score >= threshold), 0) / sum(weight) FILTER (quality <> 1) AS fpr FROM scored, c GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1"""
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.best_threshold(scored(spark, sf_dir), score="score", label=F.col("quality") == 1, weight=F.col("weight"))
    return out.select(*[r6(F.col(c)).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(
    f"""WITH {SIDES}, c AS (SELECT b AS bin, count(*) FILTER (side = 'agent') AS a, count(*) FILTER (side = 'human') AS h, count(*) FILTER (side = 'target') AS t
  FROM (SELECT unnest(range(20)) AS b) LEFT JOIN sided ON least(19, floor(score * 20)) = b GROUP BY b),
p AS (SELECT t, (a + 0.5) / (sum(a) OVER () + 10) AS a, (h + 0.5) / (sum(h) OVER () + 10) AS h FROM c),
g AS (SELECT i / 200.0::DOUBLE AS s, round(sum(t * ln(i / 200.0::DOUBLE * a + (1 - i / 200.0::DOUBLE) * h)), 9) AS ll FROM p, (SELECT unnest(range(201)) AS i) GROUP BY i),
b AS (SELECT s FROM g ORDER BY ll DESC, s LIMIT 1),
f AS (SELECT b.s + i / 2000.0::DOUBLE AS s FROM b, (SELECT unnest(range(-10, 11)) AS i) WHERE b.s + i / 2000.0::DOUBLE BETWEEN 0 AND 1),
e AS (SELECT s, round(sum(t * ln(s * a + (1 - s) * h)), 9) AS ll FROM p, f GROUP BY s)
SELECT round(s, 6) AS share FROM e ORDER BY ll DESC, s LIMIT 1"""
)
def mixture_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mixture_share(K.histograms(sided(spark, sf_dir), side="side", score="score", weight="weight")).select(r6(F.col("share")).alias("share"))


@query(
    f"""WITH {SIDES}, r AS (SELECT avg((score >= 0.5)::INT) FILTER (side = 'agent') AS tpr, avg((score >= 0.5)::INT) FILTER (side = 'human') AS fpr FROM sided),
o AS (SELECT source, avg((score >= 0.5)::INT) AS observed FROM sided WHERE side = 'target' GROUP BY source)
SELECT source, round(observed, 6) AS observed, round(CASE WHEN tpr - fpr >= 0.05 THEN greatest(0, least(1, (observed - fpr) / (tpr - fpr))) END, 6) AS share FROM o, r"""
)
def threshold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sided(spark, sf_dir)
    hit = F.col("score") >= 0.5
    rate = lambda s: weighted_rate(hit & (F.col("side") == s), F.when(F.col("side") == s, F.col("weight")))
    rates = rows.filter("side <> 'target'").agg(rate("agent").alias("tpr"), rate("human").alias("fpr"))
    per = rows.filter("side = 'target'").groupBy("source").agg(weighted_rate(hit, F.col("weight")).alias("observed"))
    out = per.join(F.broadcast(rates))
    return out.select("source", r6(F.col("observed")).alias("observed"), r6(adjusted_share(F.col("observed"), F.col("tpr"), F.col("fpr"))).alias("share"))


@query(
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c),
e AS (SELECT sum(ra * cb) AS x FROM (SELECT a, sum(n) AS ra FROM c GROUP BY a) JOIN (SELECT b, sum(n) AS cb FROM c GROUP BY b) ON a = b)
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa FROM t, e"""
)
def review_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.kappa(table(spark, sf_dir, "labels"), first="quality", second="toxic")
    return out.select("n", r6(F.col("agreement")).alias("agreement"), r6(F.col("kappa")).alias("kappa"))


@query(
    f"""WITH {SCORED}, p AS (SELECT source, coalesce(sum(weight) FILTER (score >= 0.5), 0) AS h, sum(weight) AS w FROM scored GROUP BY source), t AS (SELECT sum(h) AS hh, sum(w) AS ww FROM p)
SELECT source, round((hh - h) / (ww - w), 6) AS rate, round((hh - h) / (ww - w) - hh / ww, 6) AS shift FROM p, t"""
)
def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.leave_one_out(scored(spark, sf_dir), group="source", hit=F.col("score") >= 0.5, weight=F.col("weight"))
    return out.select("source", r6(F.col("rate")).alias("rate"), r6(F.col("shift")).alias("shift"))


@query(
    f"""WITH {SCORED}, s AS (SELECT lang, sum(weight) FILTER (score >= 0.5) / sum(weight) AS share FROM scored GROUP BY lang), g AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS c)
SELECT lang, round(min((1 - c) * share), 6) AS low, round(max(c + (1 - c) * share), 6) AS high FROM s, g GROUP BY lang"""
)
def contamination_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = scored(spark, sf_dir).groupBy("lang").agg(weighted_rate(F.col("score") >= 0.5, F.col("weight")).alias("share"))
    out = K.envelope(shares, by=["lang"], share="share", contaminations=[0.0, 0.05, 0.1, 0.2])
    return out.select("lang", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (score >= 0.5 AND quality <> 1) AS fp, count(*) FILTER (score < 0.5 AND quality <> 1) AS tn, count(*) FILTER (score < 0.5 AND quality = 1) AS fn FROM scored GROUP BY lang)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM c"""
)
def confusion_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.confusion(scored(spark, sf_dir), predicted=F.col("score") >= 0.5, actual=F.col("quality") == 1, by=["lang"])
    return out.withColumn("precision", r6(F.col("precision"))).withColumn("recall", r6(F.col("recall")))


@query(
    """SELECT source, round(sum(n_chars * (1.0 + doc_id % 3)) / sum(1.0 + doc_id % 3), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd, round(CASE WHEN count(n_chars) < 2 THEN 0 ELSE stddev_samp(n_chars) END, 6) AS sample_sd,
  list_sort(list(n_chars))[CAST(greatest(1, ceil(count(n_chars) * 0.9)) AS INTEGER)] AS p90, round(median(n_chars), 6) AS median, count(*) AS n FROM documents GROUP BY source"""
)
def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        r6(weighted_mean(x, F.lit(1.0) + F.col("doc_id") % 3)).alias("mean"),
        r6(F.stddev_pop(x)).alias("sd"),
        r6(sample_deviation(x)).alias("sample_sd"),
        nearest_rank(x, 0.9).alias("p90"),
        r6(F.percentile(x, F.lit(0.5))).alias("median"),
        F.count("*").alias("n"),
    )


@query(
    f"""WITH {SCORED} SELECT source, sum(weight) AS weight, round(sum(CASE WHEN score >= 0.5 THEN weight ELSE 0 END) / sum(weight), 6) AS rate, sum(CASE WHEN score >= 0.5 THEN weight ELSE 0 END) IN (0, sum(weight)) AS saturated FROM scored GROUP BY source HAVING sum(weight) >= 10"""
)
def group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.group_rates(scored(spark, sf_dir), by=["source"], hit=F.col("score") >= 0.5, weight=F.col("weight"), least=10)
    return out.select("source", "weight", r6(F.col("rate")).alias("rate"), "saturated")


@query(
    """WITH r AS (SELECT o_orderpriority AS p, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT p AS o_orderpriority, any_value(n) AS n, round(CASE WHEN any_value(n) < 2 THEN 1.0 ELSE greatest(max(v) FILTER (i = n * 3 // 4) - max(v) FILTER (i = n // 4), stddev_pop(v), 1e-9) END, 4) AS scale FROM r GROUP BY p"""
)
def robust_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.robust_scale(table(spark, sf_dir, "orders"), by=["o_orderpriority"], value="o_totalprice")
    return out.withColumn("scale", F.round("scale", 4))


@query(
    f"""WITH {SIDES}, clusters AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source AS c FROM sided)),
draws AS (SELECT b AS replicate, CAST(('0x' || substr(sha256('mixture' || chr(0) || b || chr(0) || place), 1, 12)) AS BIGINT) % n AS place FROM clusters, (SELECT unnest(range(2000)) AS b)),
copies AS (SELECT replicate, c, count(*) AS copies FROM draws JOIN clusters USING (place) GROUP BY replicate, c),
per AS (SELECT source, least(19, floor(score * 20)) AS bin, count(*) FILTER (side = 'agent') AS a, count(*) FILTER (side = 'human') AS h, count(*) FILTER (side = 'target') AS t FROM sided GROUP BY 1, 2),
d AS (SELECT replicate, bin, sum(a * copies) AS a, sum(h * copies) AS h, sum(t * copies) AS t FROM per JOIN copies ON source = c GROUP BY 1, 2),
f AS (SELECT r.replicate, b.bin, coalesce(a, 0) AS a, coalesce(h, 0) AS h, coalesce(t, 0) AS t FROM (SELECT DISTINCT replicate FROM copies) r CROSS JOIN (SELECT unnest(range(20)) AS bin) b LEFT JOIN d ON d.replicate = r.replicate AND d.bin = b.bin),
p AS (SELECT replicate, t, (a + 0.5) / (sum(a) OVER (PARTITION BY replicate) + 10) AS a, (h + 0.5) / (sum(h) OVER (PARTITION BY replicate) + 10) AS h FROM f),
g AS (SELECT replicate, i / 100.0::DOUBLE AS s, round(sum(t * ln(i / 100.0::DOUBLE * a + (1 - i / 100.0::DOUBLE) * h)), 9) AS ll FROM p, (SELECT unnest(range(101)) AS i) GROUP BY 1, 2),
m AS (SELECT replicate, arg_max(s, (ll, -s)) AS s FROM g GROUP BY replicate)
SELECT round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS replicates FROM m"""
)
def mixture_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mixture share over 2,000 resamples of the sources."""
    from sedimenta.operators.survival import cluster_draws

    rows = sided(spark, sf_dir)
    draws = cluster_draws(rows, cluster="source", replicates=2000, seed="mixture")
    out = K.mixture_interval(rows, draws, group="source", side="side", score="score", weight="weight")
    return out.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "replicates")


@query(
    f"""WITH {SCORED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (score >= 0.5 AND quality <> 1) AS fp, count(*) FILTER (score < 0.5 AND quality <> 1) AS tn, count(*) FILTER (score < 0.5 AND quality = 1) AS fn,
  sum(weight * pow(score - CASE WHEN quality = 1 THEN 1 ELSE 0 END, 2)) / sum(weight) AS brier FROM scored GROUP BY lang),
p AS (SELECT lang, score, sum(CASE WHEN quality = 1 THEN weight ELSE 0 END) AS pos, sum(weight) AS w FROM scored GROUP BY 1, 2),
r AS (SELECT lang, pos, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS up, sum(w) OVER (PARTITION BY lang ORDER BY score DESC) AS got FROM p),
a AS (SELECT lang, sum(pos * up / got) / sum(pos) AS average_precision FROM r GROUP BY lang)
SELECT c.lang, n, tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier FROM c JOIN a ON a.lang = c.lang"""
)
def score_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, average precision and Brier score of each language."""
    out = K.score_summary(scored(spark, sf_dir), score="score", label=F.col("quality") == 1, weight=F.col("weight"), by=["lang"])
    return out.select("lang", "n", "tp", "fp", "tn", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "average_precision", "brier")])


@query(
    f"""WITH {SCORED}, b AS (SELECT CAST(least(9, floor(score * 10)) AS INTEGER) AS bin, count(*) AS rows, sum(weight * score) / sum(weight) AS said, sum(CASE WHEN quality = 1 THEN weight ELSE 0 END) / sum(weight) AS "right" FROM scored GROUP BY 1)
SELECT bin, rows, round(said, 6) AS said, round("right", 6) AS "right", round(abs(said - "right"), 6) AS gap FROM b"""
)
def score_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and share of good documents in ten bins of the score."""
    out = K.reliability(scored(spark, sf_dir), score="score", label=F.col("quality") == 1, weight=F.col("weight"))
    return out.select("bin", "rows", *[r6(F.col(c)).alias(c) for c in ("said", "right", "gap")])
