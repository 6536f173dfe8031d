import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import order, quantification, refit
from tests.test_refit import plain_share


def test_cells_equal_plain_fits(spark):
    rng = np.random.default_rng(6)
    ref = [(lang, int(y), float(np.round(rng.beta(2 + 3 * y, 4), 4)), float(rng.integers(1, 4))) for lang in ("go", "py") for y in rng.integers(0, 2, 300)] + [("c", y, 0.5, 1.0) for y in (0, 1)]
    tgt = [(lang, tier, f"g{g}", float(np.round(rng.beta(3, 4), 4)), float(rng.integers(1, 4))) for lang in ("go", "py", "c", "rs") for tier in (1, 2) for g in range(6 if lang == "go" else 3) for _ in range(12)]
    reference = spark.createDataFrame(ref, "lang string, y int, score double, w double")
    target = spark.createDataFrame(tgt, "lang string, tier int, g string, score double, w double")
    draws = order.stratified_draws(target, unit="g", strata=[], replicates=40, seed="grid")
    got = {(r.lang, r.tier, r.weighting): r for r in quantification.mixture_grid(reference, target, draws, stratum="lang", by=["tier"], group="g", label="y", weight="w", bins=6).collect()}
    assert len(got) == 16
    copies = {}
    for d in draws.collect():
        copies.setdefault(d.replicate, {})[d.g] = d.copies
    for (lang, tier, weighting), r in got.items():
        if lang in ("c", "rs"):
            assert r.share is None and r.status == ("no_reference" if lang == "rs" else "reference_indistinguishable")
            continue
        a, h = (np.array([x[2:] for x in ref if x[0] == lang and x[1] == y]) for y in (1, 0))
        own = [x for x in tgt if x[:2] == (lang, tier)]
        total = {g: sum(x[4] for x in own if x[2] == g) for g in {x[2] for x in own}}

        def share(times):
            rows = [(x[3], x[4] / (total[x[2]] if weighting == "repository" else 1) * times.get(x[2], 0)) for x in own if times.get(x[2], 0)]
            s, w = np.array(rows).T
            return plain_share(a[:, 0], a[:, 1], h[:, 0], h[:, 1], s, w, 6)

        assert r.share == pytest.approx(share(dict.fromkeys(total, 1)), abs=6e-5)
        assert r.groups == len(total) and (r.low is None) == (r.groups < 5)
        if r.low is not None:
            assert r.replicates == 40
            each = [share(c) for c in list(copies.values())]
            assert (r.low, r.high) == pytest.approx(tuple(np.percentile(each, [2.5, 97.5])), abs=2e-4)
            assert r.status in ("identified", "mixture_does_not_fit")
        else:
            assert r.status == "too_few_groups"


def test_known_shares_are_found_in_unseen_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{part}{g}", part, float(rng.normal() + 1.5 * (g % 2)), g % 2, float(rng.integers(1, 3))) for part in ("r", "v") for g in range(30) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, part string, x double, y int, w double")
    ref, val = df.filter("part = 'r'"), df.filter("part = 'v'")
    how = {"group": "g", "features": ["x"], "label": "y", "weight": "w", "shares": [0.0, 0.3, 1.0], "trials": 30, "picks": 6, "replicates": 50, "seed": "s"}
    got = {r.share: r for r in quantification.dedicated_validation(ref, val, **how).collect()}
    assert set(got) == {0.0, 0.3, 1.0}
    for r in got.values():
        assert r.trials == 30 and r.error < 0.1 and r.error <= r.worst and abs(r.bias) <= r.error + 1e-12 and r.coverage >= 0.7
    with pytest.raises(ValueError, match="conflicting"):
        quantification.dedicated_validation(ref, val.withColumn("y", (val.x > 0).cast("int")), **how)
    with pytest.raises(ValueError, match="both labels"):
        quantification.dedicated_validation(ref, val.filter("y = 1"), **how)


def test_a_validation_reads_its_references_twice(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"{part}{g}", part, float(rng.normal() + 1.5 * (g % 2)), g % 2, 1.0) for part in ("r", "v") for g in range(20) for _ in range(10)]
    df = spark.createDataFrame(rows, "g string, part string, x double, y int, w double")
    seen = str(tmp_path / "seen")

    def told(frames):
        for frame in frames:
            with open(seen, "a") as f:
                f.write("x" * len(frame))
            yield frame

    ref = df.filter("part = 'r'").repartition(1).mapInPandas(told, df.schema)
    how = {"group": "g", "features": ["x"], "label": "y", "weight": "w", "shares": [0.3], "trials": 3, "picks": 2, "replicates": 5, "seed": "s"}
    assert quantification.dedicated_validation(ref, df.filter("part = 'v'"), **how).count() == 1
    assert len(open(seen).read()) == 2 * 200  # once for the groups, once for the blocks


def test_streamed_blocks_give_the_fits_of_packed_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(int(u), float(x), None if i == 7 else float(x**2), None if i == 5 else int(x + rng.normal() > 0), float(i % 4)) for i, (u, x) in enumerate(zip(rng.integers(0, 4, 9000), rng.normal(size=9000), strict=True))]
    df = spark.createDataFrame(rows, "u int, a double, b double, y int, w double").repartition(3)
    held = np.array([[0, 1], [2, 1], [1, 0]])  # the fourth unit takes no part
    long = spark.createDataFrame([(u, m, int(held[u, m])) for u in range(3) for m in range(2) if held[u, m]], "u int, model int, copies int")
    how = {"features": ["a", "b"], "label": df.y, "weight": df.w}
    own = refit.streamed(df, F.when(df.u < 3, df.u), held, **how)
    other = refit.packed(df, long, unit=["u"], models=2, **how)
    assert own.agg(F.sum("n")).first()[0] == other.agg(F.sum("n")).first()[0]
    a, b = (refit.fit_many(x, features=["a", "b"], models=2) for x in (own, other))
    assert np.allclose(a.beta, b.beta, atol=1e-9) and not a.failed.any()


def test_recovery_is_that_of_its_draws(spark):
    rng = np.random.default_rng(3)
    groups = [(s, f"{s}{g}", b, float(rng.integers(1, 9))) for s in (0, 1) for g in range(4) for b in range(3)]
    shape = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
    df = spark.createDataFrame(groups, "side int, g string, bin int, w double")
    got = quantification.recovery(df, shape, group="g", shares=[0.4], trials=5, picks=3, replicates=9, seed="q").first()
    import hashlib

    offs = []
    for t in range(5):
        mixed = np.zeros((2, 3))
        for s in (0, 1):
            for p in range(3):
                place = int(hashlib.sha256(f"q\0{t}\0{s}\0{p}".encode()).hexdigest()[:12], 16) % 4
                mixed[s] += [w for a, g, _, w in groups if g == f"{s}{place}" and a == s]
        mixed /= mixed.sum(axis=1, keepdims=True)
        goal = 0.4 * mixed[1] + 0.6 * mixed[0]
        grid = np.linspace(0, 1, 100001)
        ll = (goal * np.log(grid[:, None] * shape[1] + (1 - grid[:, None]) * shape[0])).sum(axis=1)
        offs.append(grid[ll.argmax()] - 0.4)
    assert (got.error, got.worst, got.bias) == pytest.approx((np.abs(offs).mean(), np.abs(offs).max(), np.mean(offs)), abs=2e-5)
