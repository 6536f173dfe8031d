import numpy as np
from pyspark.sql import functions as F

from sedimenta.functions import hashing, text
from sedimenta.operators import classify, matching, panel, quantify, relational, sampling, sequence


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (0, 0.5, 2.0), (1, 0.9, 100.0), (0, 0.1, 100.0)], "label int, score double, weight double")
    auc = quantify.weighted_auc(df, score="score", label=F.col("label") == 1, weight=F.col("weight")).first().auc
    assert abs(auc - (1 * (100 + 1) + 100 * 102) / (101 * 102)) < 1e-12
    one = quantify.weighted_auc(df.filter("label = 1"), score="score", label=F.col("label") == 1, weight=F.col("weight")).first().auc
    assert one is None


def test_mixture_share_is_recovered(spark):
    rng = np.random.default_rng(12)
    a, h = rng.normal(0.82, 0.08, 2000).clip(0, 1), rng.normal(0.18, 0.08, 2000).clip(0, 1)
    t = np.concatenate((rng.normal(0.82, 0.08, 600).clip(0, 1), rng.normal(0.18, 0.08, 1400).clip(0, 1)))
    rows = [(s, float(x), 1.0) for s, xs in (("agent", a), ("human", h), ("target", t)) for x in xs]
    df = spark.createDataFrame(rows, "side string, score double, weight double")
    share = quantify.mixture_share(quantify.histograms(df, side="side", score="score", weight="weight")).first().share
    assert abs(share - 0.3) < 0.03


def test_digest_folds_equal_python(spark):
    import hashlib

    df = spark.range(40).select(F.col("id").cast("string").alias("k"))
    for k in (5, 7, 11):
        got = {r.k: r.f for r in df.select("k", hashing.digest_modulo(hashing.nul_digest(F.col("k")), k).alias("f")).collect()}
        assert got == {x: int(hashlib.sha256(x.encode()).hexdigest(), 16) % k for x in got}
    row = df.limit(1).select(hashing.nul_digest(F.lit("a"), F.lit("b")).alias("d")).first()
    assert row.d == hashlib.sha256(b"a\0b").hexdigest()


def test_trailing_count_keeps_the_edge_and_the_order(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:15:00"), (3, "2024-01-01 00:15:00"), (4, "2024-01-01 00:15:01")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.to_timestamp("t")).withColumn("u", F.lit("x"))
    out = sequence.trailing_count(df, by=["u"], order=["t", "id"], at=F.col("t"), seconds=900, name="n")
    assert [r.n for r in out.orderBy("id").collect()] == [0, 1, 2, 2]


def test_stride_equals_the_list_rule(spark):
    for n in (3, 7, 8, 50, 101):
        df = spark.range(n).withColumn("g", F.lit(1))
        got = sorted(r.id for r in sampling.stride(df, by=["g"], order=["id"], k=7).collect())
        assert got == (list(range(n)) if n <= 7 else [int(i * n / 7) for i in range(7)])


def test_roles(spark):
    rows = [("target", "t", "h1"), ("agent", "a", "h1"), ("agent", "a", "h2"), ("human", "b", "h2"), ("agent", "a", "h3"), ("agent", "a", "h3")]
    df = spark.createDataFrame(rows, "p string, g string, h string")
    out = [(r.p, r.h, r.dropped) for r in relational.separate_roles(df, partition="p", group="g", content="h", target="target").collect()]
    assert sorted(out, key=str) == sorted([("target", "h1", None), ("agent", "h1", "target_overlap"), ("agent", "h2", "across_groups"), ("human", "h2", "across_groups"), ("agent", "h3", None), ("agent", "h3", None)], key=str)


def test_greedy_takes_each_candidate_once(spark):
    rows = [("r", "t1", 1, "c1", 1.0), ("r", "t1", 1, "c2", 2.0), ("r", "t2", 2, "c1", 0.5), ("r", "t2", 2, "c2", 3.0), ("r", "t3", 3, "c1", 0.1), ("q", "t1", 1, "c1", 1.0)]
    df = spark.createDataFrame(rows, "block string, t string, o int, c string, cost double")
    got = {tuple(r) for r in matching.greedy(df, block=["block"], target=F.col("t"), candidate=F.col("c"), order=F.col("o"), cost=[F.col("cost")]).collect()}
    assert got == {("r", "t1", "c1"), ("r", "t2", "c2"), ("q", "t1", "c1")}


def test_logit_equals_a_direct_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [2.0, 5.0] + 1
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(float)
    w = rng.random(400) + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    model = classify.fit_logit(df, features=["a", "b"], label=F.col("y") == 1, weight=F.col("w"), ridge=2.0)
    z = np.column_stack((np.ones(400), (x - x.mean(0)) / x.std(0)))
    beta, ww = np.zeros(3), w / w.mean()
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (ww * p * (1 - p))[:, None]).T @ z + np.diag([0, 2.0, 2.0]), z.T @ (ww * (y - p)) - np.array([0, 2.0, 2.0]) * beta)
    assert np.allclose(model.beta, beta, atol=1e-6)


def test_effect_is_the_change_less_the_controls(spark):
    cells = [("a", p, 10.0 + p + (5 if p >= 3 else 0)) for p in range(5)] + [("c", p, 1.0 + p) for p in range(5)] + [("d", p, 2.0 + p) for p in range(5)]
    df = spark.createDataFrame(cells, "unit string, p int, v double")
    who = spark.createDataFrame([("a", "s", 3), ("c", "s", None), ("d", "s", None)], "unit string, seg string, adopted int")
    row = panel.contrasts(df, who, unit="unit", period="p", value="v", stratum="seg").first()
    assert (row.effect, row.controls) == (5.0, 2)
    none = panel.mean_test(spark.createDataFrame([("s", 1.0)], "seg string, effect double"), by=["seg"], value="effect").first()
    assert none.t is None


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\n\n \nb\nc\n\nd",), ("",), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(text.paragraphs(F.col("t"))).collect()] == [3, 0, 0]
    urls = spark.createDataFrame([(" https://GitHub.com/Own/Name.git/ ",), ("own/name",)], "u string")
    assert {r[0] for r in urls.select(text.canonical_repository(F.col("u"))).collect()} == {"own/name"}
