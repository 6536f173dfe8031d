import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import negatives, registry
from tests.oracle import agree, connect


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (70, 33, 81), (3, 200, 90), (0, 4, 4)])
@pytest.mark.parametrize("top", [50, 1 << 40])
def test_strassen_is_exact(shape, top):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-top, top, (m, k)), rng.integers(-top // 2**20 - 9, top // 2**20 + 9, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_products_beyond_64_bits_are_clipped():
    a, b = np.array([[1 << 62, 1 << 62], [5, -7]]), np.array([[1 << 62, 1 << 61], [-(1 << 62), 0]])
    assert negatives.products(a, b).tolist() == [[negatives.MOST, -negatives.MOST], [5 * (1 << 62) - 7 * (1 << 61) if 5 * (1 << 62) - 7 * (1 << 61) < 1 << 63 else negatives.MOST, -negatives.MOST]]


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(-3, 3, (4, 60)), np.arange(60) * 2
    whole, parts = negatives.Heaps(4, 7), negatives.Heaps(4, 7)
    whole.push_tile(0, scores, ids, np.ones(scores.shape, bool))
    for at in rng.permutation(6):
        cut = slice(at * 10, at * 10 + 10)
        one = negatives.Heaps(4, 7)
        one.push_tile(0, scores[:, cut], ids[cut], np.ones((4, 10), bool))
        parts.push(*one.entries())
    assert (whole.scores == parts.scores).all() and (whole.ids == parts.ids).all()
    for r in range(4):
        assert list(zip(-whole.scores[r], whole.ids[r])) == sorted(zip(-scores[r], ids))[:7]


def brute(rows, anchor, scale, n_pos, n_neg, low, high):
    ints = {i: (lab, [int(np.floor(scale * float(np.float32(c)))) for c in x]) for i, x, lab in rows}
    out = set()
    for a, (lab, v) in ints.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i) for i, (_, w) in ints.items() if i != a and len(w) == len(v))
        for s, p in [x for x in scored if ints[x[1]][0] == lab][:n_pos]:
            fit = [x for x in scored if ints[x[1]][0] != lab and low * -s <= 100 * -x[0] <= high * -s]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit[:n_neg])}
    return out


@pytest.mark.parametrize("part_rows", [11, 8192])
def test_mining_equals_brute_force_with_odd_rows(spark, part_rows):
    rng = np.random.default_rng(7)
    vec = (rng.normal(size=(5, 4))[rng.integers(5, size=180)] + rng.normal(size=(180, 4)) * 0.5).tolist()
    vec[20:60] = [vec[20]] * 40
    good = [(i, vec[i], [0, 1, 2, 0, 0][i % 5] if i < 150 else 100 + i) for i in range(180)] + [(500, [0.0] * 4, 0), (505, [1.0, 2.0], 0), (506, [1.0, 1.9], 0), (507, [1.0, 1.0], 3)]
    odd = [(600, None, 1), (605, [], 1), (610, [float("nan"), 0.0, 0.0, 0.0], 1), (615, [None, 1.0, 1.0, 1.0], 1), (620, vec[0], None), (None, vec[0], 0), (5, vec[5], good[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<float>, label int, `row.x` string")
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, positives=4, negatives=6, low=20, high=90, part_rows=part_rows, block_rows=part_rows)
    want = brute(good, lambda i: i % 5 == 0, 256, 4, 6, 20, 90)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100
    assert any(a == 505 for a, *_ in want)
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0


def test_query(spark):
    agree(spark, connect(), registry.queries()["op11_negatives"], registry.oracle_sql()["op11_negatives"])
