import math
import random
from collections import Counter

from sedimenta.llm import lm, registry
from tests import oracle


def brute(docs, order):
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    grams = {i: Counter(tuple(w[j : j + n]) for n in range(1, order + 1) for j in range(len(w) - n + 1)) for i, w in words.items()}
    total = sum(grams.values(), Counter())
    n_all = sum(map(len, words.values()))
    out = {}
    for i, w in words.items():
        f = lambda g: total[g] - grams[i][g]  # noqa: E731, B023
        n = max(1, n_all - len(w))

        def s(j, k):
            g = tuple(w[j - k + 1 : j + 1])
            if k == 1:
                return max(f(g), lm.UNSEEN) / n
            return f(g) / f(g[:-1]) if f(g) > 0 else lm.ALPHA * s(j, k - 1)

        ks = [min(order, j + 1) for j in range(len(w))]
        out[i] = (len(w), sum(f(tuple(w[j - k + 1 : j + 1])) <= 0 for j, k in enumerate(ks)), sum(math.log(s(j, k)) for j, k in enumerate(ks)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdeFgh") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "Only once here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for order in (1, 3):
        got = {r.id: (r.n_words, r.n_backoff, r.log_score) for r in lm.score(df, order=order).collect()}
        want = brute(docs, order)
        assert got.keys() == want.keys()
        for i, (n, b, x) in want.items():
            assert got[i][:2] == (n, b) and abs(got[i][2] - x) < 1e-9 * (1 + abs(x)), i


def test_empty_single_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b", 1)], "doc_id long, text string, id int")
    row = lm.score(df).first()
    assert (row.id, row.n_words, row.n_backoff) == (None, 2, 2) and math.isfinite(row.log_score)
    assert lm.score(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    oracle.agree(spark, oracle.connect(), registry.op10_lm_scores, lm.ORACLE)
