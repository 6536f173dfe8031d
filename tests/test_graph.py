import random

import pytest

from sedimenta.operators import graph


def plain(parents, heads):
    up = {}
    for r, c, p, n in parents:
        up.setdefault((r, c), {})
        if p is not None:
            up[r, c][n] = p
            up.setdefault((r, p), {})
    out = {}
    for r, head in heads:
        line = [head]
        while 0 in up[r, line[-1]]:
            line.append(up[r, line[-1]][0])
        line.reverse()
        for position, f in enumerate(line):
            todo = [f]
            while todo:
                c = todo.pop()
                if (r, c) not in out:
                    out[r, c] = (f, position)
                    todo += up[r, c].values()
    return {(*k, *out.get(k, (None, None))) for k in up}


def test_landings_equal_a_walk(spark):
    rng = random.Random(2)
    parents, heads = [], []
    for r in range(5):
        tips = {"main": ("r", 0)}
        made = 0
        parents.append((f"r{r}", "c0", None, 0))
        tips = {b: "c0" for b in range(4)}
        for _ in range(rng.choice([1, 60, 150])):
            made += 1
            branch = rng.choice([0, 0, 1, 2, 3])
            own = f"c{made}"
            parents.append((f"r{r}", own, tips[branch], 0))
            for n, other in enumerate(rng.sample([b for b in range(4) if b != branch], rng.choice([0, 0, 1, 2]))):
                if tips[other] != tips[branch]:
                    parents.append((f"r{r}", own, tips[other], n + 1))
            tips[branch] = own
            if rng.random() < 0.1:
                tips[rng.randint(1, 3)] = tips[0]
        heads.append((f"r{r}", tips[0]))
    parents += parents[:7] + [("lost", "x", "y", 0)]
    df = spark.createDataFrame(parents, "repository string, commit string, parent string, number int")
    tips = spark.createDataFrame(heads, "repository string, commit string")
    got = {tuple(r) for r in graph.landings(df, tips).collect()}
    assert got == plain(parents, heads) and sum(r[2] is None for r in got) > 2
    assert len({r[2] for r in got}) > 50
    assert graph.landings(df.limit(0), tips.limit(0)).count() == 0


def test_cycles_are_told(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_DOUBLINGS", 3)
    df = spark.createDataFrame([("r", "a", "b", 0), ("r", "b", "a", 0)], "repository string, commit string, parent string, number int")
    with pytest.raises(ValueError, match="cycle"):
        graph.landings(df, df.select("repository", "commit").limit(1))
