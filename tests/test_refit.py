import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import order, refit


def logistic(x, y, w, ridge):
    mid, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1.0, sd)
    z, w = np.column_stack((np.ones(len(x)), (x - mid) / sd)), w / w.mean()
    pen, b = np.diag([0.0] + [ridge] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        step = np.linalg.solve(z.T @ (z * np.clip(w * p * (1 - p), 1e-8, None)[:, None]) + pen, z.T @ (w * (y - p)) - pen @ b)
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return lambda q: np.round(1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(q)), (q - mid) / sd)) @ b, -35, 35))), 12)


def plain_share(sa, wa, sh, wh, st, wt, bins):
    s, w = np.concatenate((sa, sh)), np.concatenate((wa, wh))
    o = np.lexsort((w, s))
    s, w = s[o], w[o]
    inner = np.unique(np.interp(np.linspace(0, 1, bins + 1)[1:-1], (np.cumsum(w) - w / 2) / w.sum(), s))
    edges = np.concatenate(([-np.inf], inner, [np.inf]))
    a, h = (np.histogram(v, edges, weights=u)[0] + 0.5 for v, u in ((sa, wa), (sh, wh)))
    a, h, t = a / a.sum(), h / h.sum(), np.histogram(st, edges, weights=wt)[0]
    if 0.5 * np.abs(a - h).sum() < 0.05:
        return None
    grid = np.linspace(0, 1, 20001)
    ll = [(t * np.log(np.clip(q * a + (1 - q) * h, 1e-15, None))).sum() for q in grid]
    return grid[int(np.argmax(ll))]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(24):
        for _ in range(rng.integers(4, 60) if g else 400):
            y = int(rng.random() < (0.5 if g % 3 else 0.9))
            x = rng.normal(size=2) + y * np.array([1.0, -0.6])
            rows.append((f"g{g:02d}", "reference" if g < 16 else "target", float(x[0]), float(np.round(x[1], 1)), 7.0, y, float(rng.integers(1, 5))))
    return rows


NAMES = "repo string, role string, a double, b double, c double, y int, w double"


@pytest.mark.parametrize("block", [50, 4096])
def test_every_resample_is_refitted(spark, small, monkeypatch, block):
    monkeypatch.setattr(refit, "BLOCK_ROWS", block)
    monkeypatch.setattr(refit, "GATHERED", 5)
    df = spark.createDataFrame(small, NAMES)
    ref, tgt = df.filter("role = 'reference'"), df.filter("role = 'target'")
    draws = order.stratified_draws(ref, unit="repo", strata=["y"], replicates=6, seed="s", folds=3)
    goal = order.stratified_draws(tgt, unit="repo", strata=[], replicates=6, seed="t")
    got = refit.refit_shares(ref, tgt, draws, goal, group="repo", features=["a", "b", "c"], label="y", weight="w", replicates=6, folds=3, bins=8)
    rows = {r.replicate: r for r in got.collect()}
    drawn, aimed = draws.collect(), goal.collect()
    for r in range(6):
        parts = {"x": [], "y": [], "w": [], "f": []}
        for d in drawn:
            if d.replicate == r:
                for _, _, a, b, c, y, w in [s for s in small if s[0] == d.repo and s[5] == d.y] * d.copies:
                    for k, v in zip("xywf", ([a, b, c], y, w, d.fold), strict=True):
                        parts[k].append(v)
        x, y, w, f = (np.array(parts[k], float) for k in "xywf")
        assert {y_: sum(d.copies for d in drawn if d.replicate == r and d.y == y_) for y_ in (0, 1)} == {y_: len({s[0] for s in small if s[1] == "reference" and s[5] == y_}) for y_ in (0, 1)}
        score = np.zeros(len(y))
        for k in range(3):
            score[f == k] = logistic(x[f != k], y[f != k], w[f != k], 3.0)(x[f == k])
        whole = logistic(x, y, w, 3.0)
        t = [(s[2:5], s[6]) for d in aimed if d.replicate == r for s in [s for s in small if s[0] == d.repo] * d.copies]
        st, wt = whole(np.array([v for v, _ in t])), np.array([v for _, v in t])
        want = plain_share(score[y == 1], w[y == 1], score[y == 0], w[y == 0], st, wt, 8)
        assert rows[r].failure is None and rows[r].share == pytest.approx(want, abs=6e-5)
    summary = refit.refit_interval(got).first()
    assert (summary.replicates, summary.successful, summary.failed) == (6, 6, 0) and summary.low <= summary.high


def test_failed_fits_are_told(spark, small):
    df = spark.createDataFrame([r[:5] + (1,) + r[6:] for r in small], NAMES)
    ref, tgt = df.filter("role = 'reference'"), df.filter("role = 'target'")
    draws = order.stratified_draws(ref, unit="repo", strata=["y"], replicates=2, seed="s", folds=2)
    got = refit.refit_shares(ref, tgt, draws, order.stratified_draws(tgt, unit="repo", strata=[], replicates=2, seed="t"), group="repo", features=["a"], label="y", weight="w", replicates=2, folds=2)
    assert [r.failure for r in got.collect()] == ["a fold lacks a class"] * 2
    assert refit.refit_interval(got).first().failed == 2


def test_likeliest_share_is_the_best_of_a_fine_grid():
    rng = np.random.default_rng(0)
    a, h, t = rng.dirichlet(np.ones(6), 20), rng.dirichlet(np.ones(6), 20), rng.integers(0, 50, (20, 6)).astype(float)
    grid = np.linspace(0, 1, 200001)
    for i, q in enumerate(refit.likeliest_shares(a, h, t)):
        ll = (t[i] * np.log(grid[:, None] * a[i] + (1 - grid[:, None]) * h[i])).sum(1)
        assert abs(q - grid[ll.argmax()]) < 1e-5


def test_orders_without_a_global_window(spark):
    rows = [(i * 7 % 101, i % 3 if i % 10 else None, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, g int, v int")
    got = {(r.g, r.k): r.position for r in order.numbered(df, order=["k"], by=["g"]).collect()}
    for g in (None, 0, 1, 2):
        keys = sorted(k for k, h, _ in rows if h == g)
        assert [got[g, k] for k in keys] == list(range(len(keys)))
    seq = [(i, (i // 10, "x"), i) for i in range(60)]
    seq[20], seq[41] = (20, (1, "x"), 19), (41, (4, "x"), 3)
    frame = spark.createDataFrame([(a, b[0], c) for a, b, c in seq], "pos int, p int, q int").repartition(5)
    assert {(r.pos, r.same) for r in order.order_violations(frame, sequence="pos", keys=["p", "q"]).collect()} == {(20, True), (41, False)}
    assert order.order_violations(frame.limit(0), sequence="pos", keys=["p", "q"]).count() == 0


def test_many_models_start_from_the_fit_of_their_sum(spark, small, monkeypatch):
    df = spark.createDataFrame(small, NAMES)
    ref, tgt = df.filter("role = 'reference'"), df.filter("role = 'target'")
    draws = order.stratified_draws(ref, unit="repo", strata=["y"], replicates=6, seed="s", folds=3)
    goal = order.stratified_draws(tgt, unit="repo", strata=[], replicates=6, seed="t")
    passes, plain = [], refit.summed

    def counted(blocks, features, models, sums, *args, **more):
        passes.append((models, sums.__name__))
        return plain(blocks, features, models, sums, *args, **more)

    monkeypatch.setattr(refit, "summed", counted)
    found = {}
    for many in (1, 10**6):
        monkeypatch.setattr(refit, "MANY_MODELS", many)
        passes.clear()
        shares = refit.refit_shares(ref, tgt, draws, goal, group="repo", features=["a", "b", "c"], label="y", weight="w", replicates=6, folds=3, bins=8)
        found[many] = {r.replicate: r.share for r in shares.collect()}
        found[many, "steps"] = sum(n > 1 for n, name in passes if name == "step")
    assert found[1] == pytest.approx(found[10**6], abs=1e-9)
    assert found[1, "steps"] < found[10**6, "steps"]


def test_places_among_cuts():
    rng = np.random.default_rng(3)
    score = np.concatenate((rng.random(5000), [0.0, 1.0, 0.5, 1 / refit.CELLS], np.arange(refit.CELLS + 1) / refit.CELLS))
    for cuts in (np.empty(0), np.sort(rng.random(50)), np.array([0.0, 0.25, 0.5, 1.0]), np.linspace(0, 1, refit.CELLS + 1)[1:-1], np.unique(score)):
        assert (refit._Cut(cuts).places(score) == np.searchsorted(cuts, score, side="right")).all()


def test_few_strata_do_not_deal_all_rows_to_as_few_tasks(spark):
    from sedimenta.operators.quantify import with_before

    fits = refit.Fits(["v"], np.array([[0.0, 1.0], [1.0, -1.0]]), np.zeros(2, bool))
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 'F', 'O') s", "cast(id as double) v", "1.0D w").repartition(8)
    models = spark.createDataFrame([("F", 0), ("O", 1)], "s string, model int")
    scored = refit.own_scores(df, fits, models, on="s")
    assert max(r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()) < 2000
    assert scored.filter("s = 'F' and v = 2").first().score == pytest.approx(1 / (1 + np.exp(-2)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        below = with_before(df, by=["s"], value="v", amount="w", name="below")
        assert all(r.below == r.v // 2 for r in below.collect())
        # rows that meet the span of their group
        joins = [j for j in below._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortMergeJoin" in j]
        assert joins and all("__salt" in j or "__bin" in j for j in joins)
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tasks_that_pack_blocks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(refit, "BLOCK_ROWS", 10)
    monkeypatch.setattr(refit, "TASK_BLOCKS", 2)
    df = spark.range(800).selectExpr("id % 2 g", "cast(id as double) a", "int(id % 3 = 0) y", "1.0D w")
    one = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "g long, model int, copies int")
    blocks = refit.packed(df, one, unit=["g"], features=["a"], label=F.col("y"), weight=F.col("w"), models=1)
    assert blocks.agg(F.sum("n")).first()[0] == 800
    tasks = blocks.groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    assert max(t.n for t in tasks) < 120


def test_groups_are_left_out_many_at_once(spark):
    from sedimenta.operators import quantification

    rng = np.random.default_rng(2)
    rows = [(f"r{i % 5}", int(i % 2), 1.0, float(np.clip(rng.normal(0.4 + 0.2 * (i % 2), 0.1), 0, 1))) for i in range(400)]
    goal = [(f"t{i % 7}" if i % 7 else None, 1.0 + i % 3, float(np.clip(rng.normal(0.5, 0.15), 0, 1))) for i in range(300)]
    reference, target = spark.createDataFrame(rows, "g string, y int, w double, score double"), spark.createDataFrame(goal, "g string, w double, score double")
    omitted = quantification.quantified(reference, target, group="g", label="y", weight="w", bins=6)["omitted"]
    assert "FlatMapGroupsInPandas" not in omitted._jdf.queryExecution().sparkPlan().toString()
    found = {r.g: r.share for r in omitted.collect()}
    assert len(found) == 7
    for g, share in found.items():
        rest = target.filter(~F.col("g").eqNullSafe(F.lit(g)))
        assert quantification.quantified(reference, rest, group="g", label="y", weight="w", bins=6)["point"].first().share == pytest.approx(share, abs=1e-9)
    alone = quantification.quantified(reference, target.filter("g = 't1'"), group="g", label="y", weight="w", bins=6)["omitted"].first()
    assert alone.share is None and alone.shift is None


def test_strata_without_a_fit_keep_their_rows(spark):
    from sedimenta.operators import evaluation

    fits = refit.Fits(["v"], np.array([[0.0, 1.0], [0.0, 0.0]]), np.array([False, True]))
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), (None, 2.0)], "s string, v double")
    models = spark.createDataFrame([("a", 0), ("b", 1)], "s string, model int")
    got = {r.s: r.score for r in refit.own_scores(df, fits, models, on="s").collect()}
    assert got == {"a": pytest.approx(1 / (1 + np.exp(-2))), "b": None, "c": None, None: None}

    rng = np.random.default_rng(6)
    rows = [(s, float(rng.normal() + 2 * (i % 2)), bool(i % 2) and s != "one class") for s in ("F", "one class", None) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, v double, y boolean")
    more = {"stratum": "s", "features": ["v"], "label": F.col("y"), "weight": F.lit(1.0)}
    found = {r.s: r for r in evaluation.fits_by_stratum(df, **more).collect()}
    assert set(found) == {"F", "one class", None}
    assert found["F"].reason is None and found[None].reason is None and found[None].positive == 100
    lost = found["one class"]
    assert (lost.positive, lost.negative, lost.auc, lost.tpr, lost.fpr, lost.reason) == (0, 200, None, None, None, "too_few_rows")
    found = {r.s: r.reason for r in evaluation.fits_by_stratum(df, strata=["one class", "none"], least_rows=0, **more).collect()}
    assert found == {"one class": "fit_failed", "none": "fit_failed"}

    # without the other groups' rows a model lacks a class
    alone = evaluation.left_out_groups(df.filter("s is not null"), group="s", groups=["F", "one class", "none"], features=["v"], label=F.col("y"))
    got = {r.s: (r.auc, r.rows) for r in alone.collect()}
    assert got["F"] == (None, 200) and got["one class"] == (None, 200) and got["none"] == (None, 0)


def test_rows_meet_models_only_where_their_place_depends_on_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(80):
        y = rng.integers(0, 2, 300)
        a, b = rng.normal(size=300) + y, np.round(rng.normal(size=300) - 0.5 * y, 1)
        rows += [(f"g{g:02d}", "reference" if g < 60 else "target", float(a[i]), float(b[i]), 7.0, int(y[i]), float(1 + i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, NAMES)
    ref, tgt = df.filter("role = 'reference'"), df.filter("role = 'target'")
    draws = order.stratified_draws(ref, unit="repo", strata=["y"], replicates=14, seed="s", folds=4)
    goal = order.stratified_draws(tgt, unit="repo", strata=[], replicates=14, seed="t")
    # draws are made in as many tasks, however small the table of units
    assert "REPARTITION_BY_NUM" in draws._jdf.queryExecution().sparkPlan().toString()
    run = lambda: {r.replicate: r.share for r in refit.refit_shares(ref, tgt, draws, goal, group="repo", features=["a", "b", "c"], label="y", weight="w", replicates=14, folds=4, bins=8).collect()}
    passes, plain, edges, counts, used = [], refit.summed, refit._edges, refit.counts, []

    def seen(blocks, features, models, sums, *args, **more):
        passes.append((models, sums.__name__))
        return plain(blocks, features, models, sums, *args, **more)

    def same_edges(blocks, entries, features, replicates, bins, bounds, gaps, cuts):
        found = edges(blocks, entries, features, replicates, bins, bounds, gaps, cuts)
        if gaps is not None and found is not None:
            used.append(len(gaps.low))
            whole = edges(blocks, entries, features, replicates, bins, None, None, [np.linspace(0, 1, refit.CELLS + 1)[1:-1]] * replicates)
            assert all(len(a) == len(b) and np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(found, whole, strict=True))
        return found

    def same_counts(blocks, entries, found, bounds, *, features, replicates, bins, split):
        out = counts(blocks, entries, found, bounds, features=features, replicates=replicates, bins=bins, split=split)
        whole = plain(blocks, features, replicates, refit.counted(entries, found, replicates, bins, split), whole=True)
        assert np.allclose(out, whole.reshape(out.shape), rtol=1e-12)
        x = np.array([r[2:5] for r in rows if r[1] == "reference"])
        low, high = bounds.scores(x)
        assert (low <= high).all() and (high - low).max() < 0.5
        return out

    monkeypatch.setattr(refit, "GUESS_ROWS", 100)
    monkeypatch.setattr(refit, "GATHERED", 20)
    monkeypatch.setattr(refit, "CLOSE", 1e-5)
    monkeypatch.setattr(refit, "summed", seen)
    with monkeypatch.context() as m:
        m.setattr(refit, "_edges", same_edges)
        m.setattr(refit, "counts", same_counts)
        found = run()
    # the power series tells most of the 70 models
    assert all(n < 20 for n, name in passes if name == "step")
    assert used and used[0] > 2
    monkeypatch.setattr(refit, "MANY_MODELS", 10**6)
    assert run() == pytest.approx(found, abs=2e-5)


def test_quantiles_beside_a_gap_are_looked_for_again(spark, monkeypatch):
    # guesses that miss: rows left in gaps would matter, so more of them are looked at
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i % 20, float(v), int(rng.random() < 0.3 + 0.1 * v), 1.0) for i, v in enumerate(rng.normal(size=6000))], "g long, v double, y int, w double")
    copies = spark.createDataFrame([(g, m, 1 + (g + m) % 3) for g in range(20) for m in range(3)], "g long, model int, copies int")
    blocks = refit.packed(df, copies, unit=["g"], features=["v"], label=F.col("y"), weight=F.col("w"), models=3)
    fits = refit.Fits(["v"], np.array([[0.0, 1.0], [0.01, 1.0], [0.0, 1.01]]), np.zeros(3, bool))

    def entries(b):
        yield np.arange(3), np.arange(len(b.y)), fits.scores(b.x), b.w[:, None] * b.copies[b.unit]

    bounds = refit._Bounds.of(fits.beta[:, None], np.ones(3, bool), lambda b: b.copies)
    want = refit.quantile_edges(blocks, entries, features=1, replicates=3, bins=5)
    tried, edges, guessed = [], refit._edges, refit.guessed

    def told(*args):
        out = edges(*args)
        tried.append((args[6] is not None, out is not None))
        return out

    def wrong(*args, **more):
        guess = guessed(*args, **more)
        guess.at = guess.at + 3.0
        return guess

    monkeypatch.setattr(refit, "_edges", told)
    monkeypatch.setattr(refit, "GUESS_ROWS", 200)
    near = refit.quantile_edges(blocks, entries, features=1, replicates=3, bins=5, bounds=bounds)
    assert tried == [(True, True)]
    monkeypatch.setattr(refit, "guessed", wrong)
    far = refit.quantile_edges(blocks, entries, features=1, replicates=3, bins=5, bounds=bounds)
    assert tried[1] == (True, False) and tried[-1] == (False, True)
    for got in (near, far):
        assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(got, want, strict=True))
