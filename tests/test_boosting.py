import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import boosting, quantification, refit
from tests.test_refit import NAMES, logistic, small  # noqa: F401


def split(x, r, w):
    best = (-1.0, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            wl, wr = w[left].sum(), w[~left].sum()
            gain = wl * wr / (wl + wr) * ((w * r)[left].sum() / wl - (w * r)[~left].sum() / wr) ** 2
            if gain > best[0] + 1e-12:
                best = (gain, (f, t))
    return best[1]


def plain_trees(x, y, w, rounds, rate):
    start = np.log(w[y == 1].sum() / w[y == 0].sum())
    margin, trees = np.full(len(y), start), []

    def place(q, cuts):
        root, kids = cuts
        right = q[:, root[0]] > root[1]
        out = np.zeros(len(q), int)
        for side in (0, 1):
            own = right == bool(side)
            out[own] = 2 * side
            if kids[side]:
                out[own] += q[own, kids[side][0]] > kids[side][1]
        return out

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        r = y - p
        root = split(x, r, w)
        right = x[:, root[0]] > root[1]
        cuts = (root, [split(x[right == bool(s)], r[right == bool(s)], w[right == bool(s)]) for s in (0, 1)])
        at = place(x, cuts)
        value = np.array([(w * r)[at == i].sum() / (w * p * (1 - p))[at == i].sum() if (at == i).any() else 0.0 for i in range(4)])
        margin = margin + rate * value[at]
        trees.append((cuts, value))

    def score(q):
        m = np.full(len(q), start)
        for cuts, value in trees:
            m = m + rate * value[place(q, cuts)]
        return 1 / (1 + np.exp(-m))

    return score


def test_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN", 3)
    monkeypatch.setattr(refit, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.integers(0, 30, 200) / 7, rng.normal(size=200), np.full(200, 2.0)))
    x[:, 1] = np.round(x[:, 1], 1)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 2) * np.sign(x[:, 1])))).astype(int)
    w = rng.integers(1, 4, 200).astype(float)
    g = np.arange(200) % 10
    df = spark.createDataFrame([(int(k), *map(float, v), int(t), float(u)) for k, v, t, u in zip(g, x, y, w)], "g int, a double, b double, c double, y int, w double")
    copies = spark.createDataFrame([(int(k), m, 1 + int(k == 4)) for k in range(10) for m in (0, 1) if m == 0 or k % 2], "g int, model int, copies int")
    blocks = refit.packed(df, copies, unit=["g"], features=["a", "b", "c"], label=F.col("y"), weight=F.col("w"), models=2)
    borders = boosting.thresholds(df, ["a", "b", "c"])
    fits = boosting.boost_many(blocks, borders, features=["a", "b", "c"], models=2, rounds=8, rate=0.3)
    times = 1 + (g == 4)
    for m, on in enumerate((np.ones(200, bool), g % 2 == 1)):
        # between the values of its own rows a model's thresholds may lie elsewhere
        want = plain_trees(x[on], y[on], (w * times)[on], 8, 0.3)(x[on])
        assert np.allclose(fits.scores(x[on])[:, m], want, atol=1e-9)
    assert not fits.failed.any() and len(borders[2]) == 0


def test_quantification_equals_a_plain_run(spark, small):  # noqa: F811
    df = spark.createDataFrame(small, NAMES)
    ref, tgt = df.filter("role = 'reference'"), df.filter("role = 'target'")
    scored, aimed = quantification.crossfit(ref, tgt, group="repo", features=["a", "b"], label="y", weight="w")
    found = quantification.quantified(scored, aimed, group="repo", label="y", weight="w", bins=8)
    point, omitted = found["point"].first(), {r.repo: r.share for r in found["omitted"].collect()}
    rows = [r for r in small if r[1] == "reference"]
    x, y, w = np.array([r[2:4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    place = {g: i % 5 for i, g in enumerate(sorted({r[0] for r in rows}))}
    fold = np.array([place[r[0]] for r in rows])
    s = np.zeros(len(y))
    for k in range(5):
        s[fold == k] = logistic(x[fold != k], y[fold != k], w[fold != k], 3.0)(x[fold == k])
    goal = [r for r in small if r[1] == "target"]
    t, u = logistic(x, y, w, 3.0)(np.array([r[2:4] for r in goal])), np.array([r[6] for r in goal])
    from tests.test_refit import plain_share

    assert point.share == pytest.approx(plain_share(s[y == 1], w[y == 1], s[y == 0], w[y == 0], t, u, 8), abs=6e-5)
    for g, share in omitted.items():
        keep = np.array([r[0] != g for r in goal])
        assert share == pytest.approx(plain_share(s[y == 1], w[y == 1], s[y == 0], w[y == 0], t[keep], u[keep], 8), abs=6e-5)
    pairs = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    assert point.auc == pytest.approx((pairs * w[y == 1][:, None] * w[y == 0]).sum() / (w[y == 1].sum() * w[y == 0].sum()))
    assert point.identified == (point.auc_passed and point.mixture_passed and point.agreement_passed)
    with pytest.raises(ValueError, match="share groups"):
        quantification.crossfit(ref, ref, group="repo", features=["a"], label="y", weight="w")
    with pytest.raises(ValueError, match="lacks a class"):
        quantification.crossfit(ref.filter("y = 1"), tgt, group="repo", features=["a"], label="y", weight="w", kind="trees")


def test_equal_rows_are_one_row_of_the_passes(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i % 4}", float(rng.integers(0, 5)), int(rng.random() < 0.4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a double, y int").withColumn("w", F.lit(2.0))
    copies = spark.createDataFrame([(f"g{i}", 0, 1) for i in range(4)], "g string, model int, copies int")
    blocks = refit.packed(df, copies, unit=["g"], features=["a"], label=F.col("y"), weight=F.col("w"), models=1)
    borders = [np.array([0.5, 1.5, 2.5, 3.5])]
    start = boosting.Boosted(["a"], borders, np.zeros(1), np.zeros(1, bool), 0.05)
    held = boosting._collapsed(blocks, start).select("n", "w").collect()
    assert sum(r.n for r in held) == len({r[1:] for r in rows}) == 10
    assert sum(np.frombuffer(r.w).sum() for r in held) == 6000.0
