import zlib

from pyspark.sql import functions as F

from sedimenta.llm import langid, registry


def test_held_out_accuracy_and_fold(spark):
    out = registry.op7_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = docs.join(out, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang and r.text]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_words_first_then_ngrams(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("the dog sat", "en"), ("die katze schlief", "de"), ("der hund schlief", "de")] * 5)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the dog")[0] == "en"
    assert model.predict("hund katzen")[0] == "de"
    assert model.predict("schliefen")[0] == "de"
    known = model.backoff("schliefen")
    table, logs = model.levels[4]
    grams = [table[g] for i in range(8) if (g := "<schliefen>"[i : i + 4]) in table]
    assert (known == logs[grams].mean(axis=0)).all()


def test_odd_texts_and_columns(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 ***", None, 1), (4, "ça va", "fr", 1), (4, "ça va", "fr", 1), (None, "hello there", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == 6
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "fr" for r in got if r.doc_id == 4)
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert docs.filter(langid.held_out(F.col("doc_id")).isNull()).count() == 0


def test_equals_a_plain_count(spark):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "xyzab"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
    train = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 15)]
    seen: dict = {}
    for _, t, lang in train:
        for w in re.findall("[a-z]+", t):
            seen.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    seen.setdefault((lang, n), Counter())[f"<{w}>"[i : i + n]] += 1

    def log(lang, n, item):
        size = len({x for (_, m), c in seen.items() if m == n for x in c})
        return math.log((seen[lang, n][item] + 0.5) / (sum(seen[lang, n].values()) + 0.5 * max(1, size)))

    def score(t, lang):
        total = 0.0
        for w in re.findall("[a-z]+", t):
            if any(seen[x, 0][w] for x in letters):
                total += log(lang, 0, w)
                continue
            for n in range(4, 0, -1):
                known = [g for i in range(len(w) + 3 - n) if any(seen[x, n][g := f"<{w}>"[i : i + n]] for x in letters)]
                if known:
                    total += sum(log(lang, n, g) for g in known) / len(known)
                    break
        return total / math.sqrt(max(1, len(re.findall("[a-z]+", t))))

    tests = [(i, text(rng.choice(list(letters)))) for i in range(60)] + [(99, "qq vv")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.learn(df, docs_per_lang=10_000)
    for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect():
        scores = {x: score(r.text, x) for x in sorted(letters)}
        best = max(scores, key=lambda x: (round(scores[x], 9), [-ord(c) for c in x]))
        assert r.lang_pred == best, (r.text, scores)
        assert abs(r.score - 1 / sum(math.exp(v - scores[best]) for v in scores.values())) < 1e-9
