from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import bpe


def test_stages_on_a_small_corpus(spark):
    words = "the cat of and in to was on that for with from".split()
    line = lambda k: " ".join(words[(k * 7 + j * j * (k % 5 + 1)) % 12] + str((k * 31 + j) % 97) for j in range(12))
    rows = [(i, f"{line(2 * i)}\n{line(2 * i + 1)}", "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(40, rows[3][1], "en", "s0", 1), (41, None, "en", "s0", 1), (42, "123 456", None, "s1", 1), (43, f"{line(6)}\nsomething else here", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == docs.columns and ids(one) == Counter({i: 1 for i, t, *_ in rows if i not in (41, 42)})
    two = corpus_pipeline.line_dedup(spark, one, "")
    assert two.schema == docs.schema and ids(two) == Counter({i: 1 for i, *_ in rows if i not in (40, 41, 42)})
    assert [r.text for r in two.filter("doc_id = 43").collect()] == ["something else here"]
    near = spark.createDataFrame([(100, rows[0][1] + " tail", "en", "s0", 1), (100, rows[0][1] + " tail", "en", "s0", 1), (None, "x", "en", "s0", 1)], docs.schema)
    three = corpus_pipeline.near_duplicates(spark, two.unionByName(near), "")
    assert three.columns == docs.columns and ids(three) == ids(two) + Counter([None])
    four = corpus_pipeline.mix(spark, three, "")
    counts = ids(four)
    assert four.columns == docs.columns and max(counts.values()) <= 3 and set(counts) <= set(ids(three))
    five = corpus_pipeline.encode(spark, four, "").collect()
    codec = bpe.WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in three.collect()}
    assert Counter(r.doc_id for r in five) == counts
    assert all(r.ids == codec.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in five)


def test_run_and_empty_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 20
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rows int, score double, lang_pred string, n_lines int, size int, Target int, copies int, own_size int, once long, stay long, row_key long, first_row int"


def test_columns_of_any_name_keep_their_values(spark):
    words = "the cat of and in to was on that for with from".split()
    text = lambda k: " ".join(words[(k * 7 + j) % 12] + str((k * 31 + j) % 97) for j in range(30))
    rows = [(i, text(i), "en", f"s{i % 2}", 5, 1, 2.0, "own", 3, 4, 5, 6, 7, 8, 9, 10, 11) for i in range(20)]
    docs = spark.createDataFrame(rows, CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in CLASHING.split(", ")]
        values = docs.select(*docs.columns[5:]).distinct().collect()
        assert [tuple(r) for r in values] == [rows[0][5:]]


def test_different_texts_of_one_id_stay_and_long_texts_pass(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long, "en", "s", 1), (1, "quite another text than that of the long one", "en", "s", 1), (2, long + " end", "en", "s", 1), (None, "no id but a text of some words here", "en", "s", 1), (3, "alone " * 8, "en", "s", 1), (3, "alone " * 8, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.repartition(4)):
        got = sorted(((r.doc_id, len(r.text), r.n_chars) for r in corpus_pipeline.near_duplicates(spark, d, "").collect()), key=str)
        assert got == sorted([(2, len(long) + 4, 1), (1, 44, 1), (None, 35, 1), (3, 48, 1)], key=str)
