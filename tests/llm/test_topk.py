import numpy as np
import pytest

from sedimenta.llm import topk


@pytest.mark.parametrize(("n", "nq", "dim", "clusters"), [(700, 60, 5, 6), (300, 300, 16, 1), (40, 3, 2, 40), (1, 1, 3, 1)])
def test_dual_tree_equals_brute_force(n, nq, dim, clusters):
    rng = np.random.default_rng(n)
    mid = rng.normal(size=(clusters, dim)) * 900
    rows = np.floor(mid[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 60).astype(np.int64)
    rows[n // 2 :: 7] = rows[0]
    queries, ids = rows[:nq], np.arange(n) * 3
    tree = topk.DualTree(queries, ids[:nq], rows, ids, 10, np.full(nq, -np.inf))
    tree.run()
    scores = queries @ rows.T
    for i in range(nq):
        want = sorted((-s, j) for s, j in zip(scores[i], ids, strict=True) if j != ids[i])[:10]
        assert list(zip(-tree.scores[i], tree.found[i], strict=True)) == want


def test_cover_tree_covers():
    points = np.random.default_rng(3).normal(size=(500, 4))

    def walk(node):
        d = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        for c in node.children:
            walk(c)

    walk(topk.cover_tree(points))


def test_search_with_odd_rows_blocks_and_parts(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(240, 3)).tolist()
    v[10:60] = [v[10]] * 50
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0, 0.0, 0.0], 0), (1002, [float("inf"), 0.0, 0.0], 0), (1003, [None, 1.0, 1.0], 0), (1100, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (3, v[3], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.search(df, df.filter("vec_id % 10 = 0"), k=10, cells=5, sample_rows=50, part_rows=16, block_queries=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * float(np.float32(c)))) for c in x] for i, x, _ in rows[:240]} | {1001: [0, 0, 0]}
    for q in [i for i in ints if i % 10 == 0]:
        want = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert 1100 not in got and 1000 not in got
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
