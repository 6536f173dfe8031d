import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sedimenta.functions import dates, identity, style, templates
from sedimenta.operators import contracts, evidence, matching, order, panel, quantify, rollups, sequence, summaries, survival
from sedimenta.sources import readers, writers

BLAME = "".join(f"{c * 40} {i} {n} 1\nauthor X\n\t{t}\n" for c, i, n, t in [("a", 1, 1, "x = 1"), ("a", 2, 2, "\tindented"), ("b", 1, 3, "")])


def test_blame_and_name_status(spark):
    df = spark.createDataFrame([("f", BLAME), ("g", None)], "path string, t string")
    got = [(r.line, r.commit[0], r.text) for r in readers.blame_lines(df, keys=["path"], text="t").orderBy("line").collect()]
    assert got == [(1, "a", "x = 1"), (2, "a", "\tindented"), (3, "b", "")]
    df = spark.createDataFrame([("c", "M\ta.py\nR100\tb.py\tc.py\nnothing")], "c string, t string")
    assert {tuple(r)[1:] for r in readers.name_status(df, keys=["c"], text="t").collect()} == {("M", "a.py", "a.py"), ("R", "b.py", "c.py")}
    counts = spark.createDataFrame([("c", 1, 0, "a.py"), ("c", 5, 5, "vendor/b.py"), ("d", 0, 0, "a.py"), ("e", 1, 1, "a.go")], "c string, added long, deleted long, path string")
    assert {(r.c, r.path) for r in readers.kept_history(counts, key="c", language="Python").collect()} == {("c", "a.py")}


def test_writers(spark, tmp_path):
    rows = [(1, i, n) for i, n in enumerate([60, 50, 40, 10, 300, 5, 5, 5])]
    df = spark.createDataFrame(rows, "g int, i int, n int")
    packed = writers.packed(df, by=["g"], order="i", size=F.col("n"), most_bytes=100, most_rows=2)
    assert [r.file for r in packed.orderBy("i").collect()] == [0, 1, 1, 2, 3, 4, 4, 5]
    told = writers.write_filtered(df, str(tmp_path / "f"), keep=F.col("n") > 40, key="g").first()
    assert (told.rows, told["keys"], spark.read.json(str(tmp_path / "f")).count()) == (3, 1, 3)
    writers.write_cases(df, str(tmp_path / "c"), case="g")
    assert (tmp_path / "c" / "g=1").exists()
    counts = writers.write_histories(df.select("i", F.lit("cutoff").alias("reason")), str(tmp_path / "h"), line="i", reason="reason").first()
    assert (counts.reason, counts.n) == ("cutoff", len(rows))
    sums = writers.manifest(df, by=["g"], key="i")
    assert writers.verified(df, sums, by=["g"], key="i").count() == 0
    assert [r.problem for r in writers.verified(df.filter("i > 0"), sums, by=["g"], key="i").collect()] == ["rows"]
    done = spark.createDataFrame([(1, "a", "ok"), (2, "a", "error"), (3, "b", "ok")], "u int, contract string, status string")
    plan = spark.createDataFrame([(u, "a") for u in (1, 2, 3, 4)], "u int, contract string")
    assert {(r.u, r.reuse) for r in writers.reusable(plan, done, key="u", contract=["contract"], status="status", retry=["error"]).collect()} == {(1, True), (2, False), (3, False), (4, False)}


def test_repeated_rows_and_null_groups_stay(spark):
    left = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (2, 5, 0)], "k int, target int, least int")
    right = spark.createDataFrame([(1, 3, 0, "a"), (1, 9, 1, "b"), (1, 11, 2, "c")], "k int, t int, p int, v string")
    got = sequence.as_of(left, right, by=["k"], target="target", time="t", position="p", least="least", value="v")
    assert sorted((r.k, r.found or "") for r in got.collect()) == [(1, "b"), (1, "b"), (2, "")]
    spans = spark.createDataFrame([(1, 0, 20, "x")], "k int, s int, e int, label string")
    assert sorted(r.label for r in summaries.valid_labels(left, spans, key="k", at="target", start="s", end="e", label="label", none="-").collect()) == ["-", "x", "x"]
    rows = spark.createDataFrame([(g, s, y) for g in ("a", None) for s, y in ((0.1, 0), (0.4, 1), (0.3, 0), (0.2, 1))], "g string, s double, y int")
    got = {r.g: r.auc for r in quantify.weighted_auc(rows, score="s", label=F.col("y") == 1, weight=F.lit(1.0), by=["g"]).collect()}
    assert got == {"a": 0.75, None: 0.75}


def test_identities_and_templates(spark):
    df = spark.createDataFrame([("  Ｊörg  Straße ", "A b@X.org", "o/r")], "n string, e string, r string")
    got = df.select(identity.author_name(F.col("n")).alias("n"), identity.author_email(F.col("e")).alias("e")).first()
    assert (got.n, got.e) == ("jörg strasse", "ab@x.org")
    t = spark.range(1).select(
        templates.rendered(F.lit("{a}-{b}"), a=F.lit("1"), b=F.lit("$2")).alias("x"), templates.rendered(F.lit("{a}{a}"), a=F.lit("1")).alias("y"),
        templates.replaced_once(F.lit("after:1 z"), r"after:\d+", F.lit(r"after:$9")).alias("z"),
    ).first()
    assert (t.x, t.y, t.z) == ("1-$2", None, "after:$9 z")


def test_deviation_is_one_fold(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 90) for _ in range(500)]
    text = "\n".join("x" * v for v in values)
    got = style.source_features(spark.createDataFrame([(1, text, "Go")], "i int, t string, l string"), text="t", language="l").first()
    assert got.line_len_sd == pytest.approx(np.std(values, ddof=1))


def test_nearest_units_against_a_plain_loop(spark):
    rng = random.Random(5)
    make = lambda n, off: [(f"b{rng.randint(0, 3)}", off + i, rng.random() * 10, rng.choice("xy"), rng.choice("pq")) for i in range(n)]
    a, b = make(30, 0), make(40, 1000)
    schema = "b string, u long, v double, t string, l string"
    got = matching.greedy_nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), block=["b"], unit="u", numbers={"v": 2.0}, labels=["l"], tier="t", caliper=1.5, packs=3)
    from hashlib import sha256

    free, want = {r[1]: r for r in b}, {}
    for blk, u, v, t, lab in sorted(a, key=lambda r: r[1]):
        pool = [c for c in free.values() if c[0] == blk]
        same = [c for c in pool if c[3] == t]
        if not pool:
            want[u] = (None, "no_overlap")
            continue
        d, _, c = min(((((v - c[2]) / 2) ** 2 + (c[4] != lab)) ** 0.5, sha256(str(c[1]).encode()).hexdigest(), c) for c in (same or pool))
        want[u] = (None, "outside_caliper") if d > 1.5 else (c[1], "same_tier" if same else "same_block")
        if d <= 1.5:
            del free[c[1]]
    assert {r.target: (r.candidate, r.basis) for r in got.collect()} == want


def test_synthetic_mixtures_are_recovered(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", side, min(0.999, max(0.0, rng.gauss(0.7 if side == "agent" else 0.3, 0.12))), 1.0) for g in range(12) for side in ("agent", "human") for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, side string, s double, w double")
    got = quantify.synthetic_recovery(df, group="g", side="side", score="s", weight="w", shares=[0.2, 0.8], trials=6, picks=5, seed="t").collect()
    assert len(got) == 2 and all(r.trials == 6 and r.error < 0.08 for r in got)


def test_intervals_dates_and_contracts(spark):
    got = [(str(r.lo), str(r.hi)) for r in dates.overlapping_intervals(spark, "2024-01-01", "2024-02-05").orderBy("position").collect()]
    assert got == [("2024-01-01", "2024-01-16"), ("2024-01-14", "2024-01-30"), ("2024-01-28", "2024-02-05")]
    assert rollups.forbidden_fields(spark.createDataFrame([Row(a=[Row(b=1)], m={"k": Row(c=2)})]).schema, {"b", "c"}) == ["a.[].b", "m.{}.c"]
    assert hasattr(contracts, "__doc__") and hasattr(survival, "stratum_shares")
    empty = spark.createDataFrame([], "k int, frame string, s int")
    assert evidence.memberships({"x": empty}, key="k", snapshot="s").count() == 0


def test_drawn_effects_equal_joined_draws(spark, monkeypatch):
    monkeypatch.setattr(panel, "CHUNK", 7)
    monkeypatch.setattr(panel, "PLACES", 5)
    rows = [(f"s{i % 2}", i, float(i * i % 17)) for i in range(60)] + [("s1", 7, 3.5), ("s2", 99, 1.0)]
    effects = spark.createDataFrame(rows, "seg string, cust int, effect double")
    draws = order.stratified_draws(effects, unit="cust", strata=["seg"], replicates=40, seed="e")
    want = panel.bootstrap_effects(effects, draws.drop("seg"), unit="cust", by=["seg"], effect="effect")
    got = panel.drawn_effects(effects, unit="cust", stratum="seg", effect="effect", replicates=40, seed="e")
    plain = lambda df: sorted((r.seg, round(r.low, 9), round(r.high, 9), r.replicates) for r in df.collect())
    assert plain(got) == plain(want)


def test_alike_takes_null_for_unlike_all():
    assert matching._alike(np.array(["a", None], object), None).tolist() == [False, False]
    assert matching._alike(np.array(["a", None], object), "a").tolist() == [True, False]


def test_quantiles_of_counts_equal_percentiles(spark):
    grid = [0.02 * i for i in range(1, 50)]
    rows = [(random.Random(i).random() ** 3,) for i in range(301)] + [(0.25,)] * 40 + [(None,)] * 3
    df = spark.createDataFrame(rows, "v double")
    want = df.agg(F.percentile("v", F.array(*[F.lit(g) for g in grid]))).first()[0]
    got = quantify._quantiles(df.groupBy("v").agg(F.count("*").alias("n")), "v", "n", grid)
    assert got == pytest.approx(want, abs=1e-12)
