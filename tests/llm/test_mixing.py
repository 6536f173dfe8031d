from pyspark.sql import functions as F

from sedimenta.llm import mixing
from sedimenta.llm.text import word_count


def mixed(docs, **kw):
    plan = mixing.mix_plan(docs, size=word_count(F.col("text")), **kw)
    return mixing.pareto_mix(docs, plan, size=word_count(F.col("text")), **kw)


def test_targets_share_by_weight_and_stop_at_three_times(spark):
    # b is tiny: its share would be above 3 times its size, the rest is shared again
    rows = [(i, "w " * 10, s) for s, n in (("a", 60), ("b", 2), ("c", 40), (None, 30)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.source_size, r.target, r.taken) for r in mixed(docs).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    total = 1320.0
    rest = total - 60
    assert got["b"][1] == 60
    want = {"a": rest / 5, "c": rest * 3 / 5, None: rest / 5}
    for s, t in want.items():
        assert abs(got[s][1] - t) < 1e-6
        assert abs(got[s][2] - t) <= 5
    assert got["b"][2] == 60


def test_reruns_agree_and_copies_are_bounded(spark):
    rows = [(i, "x " * (1 + i * 7919 % 50), f"s{i % 5}" if i % 11 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((r.doc_id, r.copies) for r in mixed(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b
    assert all(0 <= c <= 3 for _, c in a)


def test_weights_change_the_chance(spark):
    rows = [(i, "x", "s", 1.0 if i % 2 else 3.0) for i in range(2000)] + [(5000 + i, "y " * 3, "t", 1.0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    out = mixed(docs, weight=F.col("w")).filter("source = 's'").groupBy("w").agg(F.avg("copies").alias("c")).collect()
    mean = {r.w: r.c for r in out}
    assert mean[3.0] > 1.5 * mean[1.0]


def test_null_empty_repeated_and_clashing_rows(spark):
    rows = [(1, None, None, 1.0), (2, "", "a", 1.0), (3, "one two", "a", 1.0), (3, "one two", "a", 1.0), (None, "x", "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = mixed(docs).collect()
    assert len(out) == 5 and all(r.copies is not None for r in out)
    assert mixed(docs.limit(0)).count() == 0


def taken(docs, **kw):
    out = mixed(docs, **kw).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    return {r.source: (r.t, r.n) for r in out}


def test_rows_without_ids_and_equal_rows_reach_the_target(spark):
    rows = [(None, "w " * 10, "a", k) for k in range(100)] + [(k, "w " * 10, "b", k) for k in range(100)] + [(7, "same row " * 5, "c", 0)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    for t, n in taken(docs).values():
        assert abs(t - n) <= 10
    assert taken(docs) == taken(docs.repartition(5))


def test_rows_at_the_limit_leave_their_rest_to_the_others(spark):
    rows = [(i, "w " * 10, "s", 100.0 if i < 20 else 1.0) for i in range(100)] + [(500 + i, "w " * 20, "t", 1.0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = mixed(docs, weight=F.col("w"))
    for t, n in taken(docs, weight=F.col("w")).values():
        assert abs(t - n) <= 20
    assert {r.copies for r in got.filter("source = 's' and w = 100").collect()} == {3}


def test_inclusion_follows_unequal_odds(spark):
    rows = [(i, "x", "s", float(1 + i % 4)) for i in range(4000)] + [(9000 + i, "y", "t", 1.0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    mean = {r.w: r.c for r in mixed(docs, weight=F.col("w")).filter("source = 's'").groupBy("w").agg(F.avg("copies").alias("c")).collect()}
    assert all(abs(mean[w] / mean[4.0] - w / 4) < 0.06 for w in mean)


def test_columns_of_the_same_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 50_000, "a", 1, 2), (2, "w", "a", 1, 2)], "doc_id long, text string, source string, words int, Rank int")
    got = mixed(docs)
    assert got.columns == ["doc_id", "text", "source", "words", "Rank", "size", "source_size", "target", "copies"] and got.count() == 2
