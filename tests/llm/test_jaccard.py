import random

import numpy as np
import pytest

from sedimenta.llm import exchange, jaccard
from sedimenta.llm.components import components


def brute(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    return {(i, len(sets[i]), comp[i]) for i in ids}


def corpus(seed, n):
    """Copies, chains of ever more edited copies, near copies just short of a link, shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(90)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.5:
            w = passage + [word() for _ in range(rng.randint(0, 20))]
        elif kind < 0.6 and docs:
            w = rng.choice(docs).split()
            w = w[: max(1, len(w) - rng.randint(0, 12))]
        elif kind < 0.65:
            w = [word() for _ in range(rng.randint(0, 4))]
        else:
            w = [word() for _ in range(rng.randint(5, 60))] + (passage if rng.random() < 0.3 else [])
        docs.append(" ".join(w).title() if rng.random() < 0.2 else "\n ".join(w))
    return list(enumerate(docs))


@pytest.mark.parametrize(("n", "unit_rows"), [(160, 1024), (120, 7)])
def test_equals_brute_force(spark, n, unit_rows):
    docs = [*corpus(n, n), (9001, None), (9002, ""), (9003, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard.near_components(df, unit_rows=unit_rows).collect()
    assert {(r.id, r.n, r.component) for r in got} == brute(docs)
    assert len(got) == len(docs)


def test_empty_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text, 1), (5, text, 1), (3, text.upper(), 1), (None, text, 1)], "doc_id long, text string, n int")
    got = sorted(((r.id is None, r.id, r.n, r.component) for r in jaccard.near_components(df).collect()), key=str)
    assert got == sorted([(False, 5, 4, 3), (False, 5, 4, 3), (False, 3, 4, 3), (True, None, 4, None)], key=str)
    assert jaccard.near_components(df.limit(0)).count() == 0


def test_links_join_all_and_only_linked():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(20, 60))) for _ in range(50)]
    sizes = np.array([len(s) for s in sets])
    sides = rng.integers(0, 2, size=50)
    for s in (None, sides):
        up = list(range(50))
        for a in range(50):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= 50 * (sizes[a] + sizes[b] - o) and (s is None or s[a] != s[b]):
                    x, y = up[a], up[b]
                    up = [min(x, y) if v in (x, y) else v for v in up]
        mine = jaccard._Sets(50)
        for a, b in jaccard.links(sizes, sets, 50, s):
            mine.join(a, b)
        assert all((mine.find(a) == mine.find(b)) == (up[a] == up[b]) for a in range(50) for b in range(a))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_exchange_totals(spark):
    rng = np.random.default_rng(2)
    blocks = {b: np.unique(rng.integers(0, 1 << 20, size=3000, dtype=np.uint64) << np.uint64(36)) for b in range(4)}
    rows = [r for b, k in blocks.items() for r in exchange.send(b, k, np.full(len(k), b + 1), 56, 8).itertuples(index=False)]
    back = exchange.totals(spark.createDataFrame([(int(r[0]), int(r[1]), r[2], r[3]) for r in rows], exchange.SENT), 56, 8).toPandas()
    for b, keys in blocks.items():
        want = sum(np.isin(keys, other) * (c + 1) for c, other in blocks.items())
        assert (exchange.received(back[back.block == b]) == want).all()
