import numpy as np
from pyspark.sql import functions as F

from sedimenta.llm import ann, registry


def brute(ids, v, q_ids, k):
    out = {}
    for q in q_ids:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        order = [(x, i) for x, i in sorted(zip(d, ids, strict=True)) if i != q][:k]
        out[q] = order
    return out


def test_rotation_keeps_lengths_and_first_axis_is_nearest():
    x = np.random.default_rng(0).normal(size=(5, 6))
    y = np.zeros((5, 8))
    y[:, :6] = x
    assert np.allclose(np.linalg.norm(ann.hadamard(y), axis=1), np.linalg.norm(x, axis=1))
    a = ann.axes(x, 3, 16, 1)
    assert a.shape == (5, 3, 16) and all(sorted(r) == list(range(16)) for r in a.reshape(-1, 16).tolist())


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=10).collect()
    want = brute(ids, v, [i for i in ids if i % 20 == 0], 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert all(len(by[q]) == 10 for q in want)
    hits = sum(i in by[q] for q, xs in want.items() for _, i in xs)
    assert hits >= 0.9 * 10 * len(want)
    for q, xs in want.items():
        for d, i in xs:
            assert i not in by[q] or abs(by[q][i] - d) < 1e-12


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (100, [2.0, 0.0], 1), (None, [1.0, 1.0], 1), (200, [], 1), (300, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id % 100 = 0"), k=10, part_rows=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 2, 2.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 3.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_query(spark):
    out = registry.queries()["op5_nearest"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert out.groupBy("query_id").count().filter(F.col("count") != 10).count() == 0
