import pytest
from pyspark.sql import functions as F

from sedimenta.operators import survival as S


def test_product_limit_on_three_lines(spark):
    rows = [("r", "a", 60.0, True), ("r", "b", 120.0, False)]
    df = spark.createDataFrame(rows, "repo string, line string, time double, died boolean").withColumn("weight", F.lit(1.0))
    got = {r.horizon: (r.survival, r.risk_rows) for r in S.kaplan_meier(df, time="time", event=F.col("died"), weight="weight", horizons=[30, 90, 180]).collect()}
    assert got == {30: (1.0, 2), 90: (0.5, 1), 180: (0.5, 0)}


def test_ties_and_censoring_at_an_event_time(spark):
    rows = [(90.0, True), (90.0, False), (400.0, False), (90.0, True)]
    df = spark.createDataFrame(rows, "time double, died boolean").withColumn("weight", F.lit(1.0))
    got = {r.horizon: r.survival for r in S.kaplan_meier(df, time="time", event=F.col("died"), weight="weight", horizons=[89, 90]).collect()}
    assert got == {89: 1.0, 90: 0.5}


def test_balanced_against_plain_weights(spark):
    rows = [("small", 10, True)] + [("large", 400, False)] * 9
    df = spark.createDataFrame(rows, "repo string, time int, died boolean")
    balanced = S.kaplan_meier(S.balanced_weights(df, cluster=["repo"]), time="time", event=F.col("died"), weight="weight", horizons=[30]).first()
    plain = S.kaplan_meier(df.withColumn("weight", F.lit(1.0)), time="time", event=F.col("died"), weight="weight", horizons=[30]).first()
    assert (round(balanced.survival, 9), round(plain.survival, 9)) == (0.5, 0.9)


def test_occupancy_has_mass_one_and_equals_the_curve(spark):
    rows = [(i, i % 3 == 0 and i * 2 or None, i % 4 == 0 and i * 5 or None, i * 6) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "id int, m int, d int, c int").withColumn("weight", F.lit(1.0))
    occ = {r.horizon: r for r in S.occupancy(df, modified="m", deleted="d", censored="c", weight="weight", horizons=[0, 50, 200, 500]).collect()}
    assert occ[0].unchanged == 1.0
    assert all(abs(r.unchanged + r.modified + r.deleted - 1) < 1e-9 for r in occ.values())
    assert occ[50].deleted <= occ[200].deleted <= occ[500].deleted


def test_interval_is_repeatable(spark):
    rows = [(f"r{i % 7}", i % 50 * 8, i % 3 == 0) for i in range(300)]
    df = S.balanced_weights(spark.createDataFrame(rows, "repo string, time int, died boolean"), cluster=["repo"])
    draws = S.cluster_draws(df, cluster="repo", replicates=30, seed="x")
    assert draws.groupBy("replicate").agg(F.sum("copies").alias("n")).filter("n <> 7").count() == 0
    run = lambda d: S.bootstrap_survival(d, draws, cluster="repo", time="time", event=F.col("died"), weight="weight", horizons=[180]).first()
    a, b = run(df), run(df.repartition(5))
    assert a.low == pytest.approx(b.low) and a.high == pytest.approx(b.high) and a.low <= a.high
