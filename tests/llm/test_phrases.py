import random
import re
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm import phrases, registry
from sedimenta.llm.transducer import CountTransducer, in_order, relabelled, union
from tests.oracle import agree, connect


def made(counts):
    words = sorted({w for g in counts for w in g})
    rows = np.array([[words.index(w) for w in g] + [-1] * (4 - len(g)) for g in counts], np.int64).reshape(-1, 4)
    order = in_order(rows)
    return CountTransducer.build(words, rows[order], np.array(list(counts.values()), np.int64)[order])


def read(t):
    grams, counts = t.paths(4)
    return {tuple(t.words[w] for w in g if w >= 0): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}


def test_automata_keep_union_and_compose():
    rng = random.Random(3)

    def some():
        return {tuple(rng.choice([b"a", b"b", b"c", "é".encode(), b"\x00"]) for _ in range(rng.randint(1, 4))): rng.randint(1, 3) for _ in range(200)}

    parts = [some() for _ in range(5)] + [{}]
    automata = [CountTransducer.from_bytes(made(p).to_bytes()) for p in parts]
    assert [read(t) for t in automata] == parts
    # equal endings are one state
    assert len(automata[0].weight) < len({g[:i] for g in parts[0] for i in range(5)})
    total = Counter()
    for p in parts:
        total.update(p)
    both = union(automata, 4, least=4)
    assert read(both) == {g: c for g, c in total.items() if c >= 4}
    asked = [(b"a",), (b"a", b"zz"), (b"zz",), (b"a", b"b"), (b"c", b"c", b"c", b"c"), *list(total)[:40]]
    words = sorted({w for g in asked for w in g})
    rows = np.array([[words.index(w) for w in g] + [-1] * (4 - len(g)) for g in asked])
    assert both.composed(words, rows).tolist() == [total[g] if total[g] >= 4 else 0 for g in asked]
    assert made({}).composed(words, rows).tolist() == [0] * len(asked)
    assert relabelled([b"x", b"b", b"a"], np.array([[2, -1], [1, 2]]))[0] == [b"a", b"b"]


def brute(rows, least, top, covered):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                count.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    cand = {g: a for g, a in count.items() if len(g) > 2 and a >= least}
    cover = Counter()
    for g, a in cand.items():
        for i in range(1, len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g) - 1:
                    cover[g[0], *g[i:j]] = max(cover[g[0], *g[i:j]], a)
    out = {}
    for g, a in cand.items():
        if g in cover and 100 * cover[g] >= covered * a:
            continue
        score, _, l, r = min((1000 * a * n[g[0]] // (count[g[: 1 + k]] * count[(g[0], *g[1 + k :])]), k, count[g[: 1 + k]], count[(g[0], *g[1 + k :])]) for k in range(1, len(g) - 1))
        out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])}


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_collocations_equal_brute_force_with_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rng = random.Random(8)
    vocab = ["new", "York", "ist", "été", "a b", "x\x00y", "日本", "the", "of", "The"]
    texts = [" ".join(rng.choice(vocab[: rng.choice([3, 10])]) + rng.choice(["", "", "", ".", ",\t", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("fr", ""), ("fr", " .,;\n"), ("en", "same old words here " * 30), ("und", "a b a b c")] + [("en", "copied words of a text")] * 20
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, `a.b` int")
    got = phrases.collocations(df, least=6, top=40, covered_percent=90, range_bytes=3000)
    assert {tuple(r) for r in got.collect()} == brute(rows, 6, 40, 90)
    few = phrases.frequent_ngrams(df, least=6, filter_bits=9)
    assert few.filter("words = 1 and lang = 'en' and phrase = 'copied'").collect()[0].a == 20
    assert phrases.collocations(df.limit(0)).count() == 0


def test_query(spark):
    agree(spark, connect(), registry.queries()["op13_phrases"], registry.oracle_sql()["op13_phrases"])
