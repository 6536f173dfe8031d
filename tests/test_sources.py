from pyspark.sql import functions as F

from sedimenta.operators import lineage
from sedimenta.sources import readers, writers

PATCH = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a = 1\n-b = compute(1)\n+b = compute(2)\n+\n+new = 3\n"


def test_json_lines_and_tsv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert {r.x for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect() if r.x} == {1, 2}
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0
    (tmp_path / "m.tsv").write_text("a\tx\nb\ty\na\tz\n")
    assert {(r.k, r.v) for r in readers.tsv_map(spark, str(tmp_path / "m.tsv"), key="k", value="v").collect()} == {("a", "z"), ("b", "y")}


def test_log_and_numstat(spark, tmp_path):
    (tmp_path / "log").write_text("c1\0me\0first\x1e\nc2\0you\0second\x1e")
    assert [tuple(r) for r in readers.git_log(spark, str(tmp_path / "log"), fields=["commit", "author", "subject"]).collect()] == [("c1", "me", "first"), ("c2", "you", "second")]
    df = spark.createDataFrame([("c1", "3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png\n0\t2\told.py => new.py")], "c string, t string")
    assert {(r.added, r.deleted, r.path) for r in readers.numstat(df, key="c", text="t").collect()} == {(3, 1, "src/b/x.py"), (None, None, "img.png"), (0, 2, "new.py")}


def test_patch_lines(spark):
    df = spark.createDataFrame([("r", PATCH), ("s", None)], "repo string, patch string")
    got = {(r.kind, r.old_line, r.new_line, r.text) for r in readers.patch_lines(df, keys=["repo"], text="patch").collect()}
    assert got == {("removed", 2, None, "b = compute(1)"), ("added", None, 2, "b = compute(2)"), ("added", None, 3, ""), ("added", None, 4, "new = 3")}
    assert {r.new_line for r in readers.added_lines(df, keys=["repo"], text="patch").collect()} == {2, 4}


def test_lines_are_followed(spark):
    patches = spark.createDataFrame([("r", 1, "c1", PATCH), ("r", 2, "c2", "--- a/x.py\n+++ b/x.py\n@@ -1,1 +0,0 @@\n-a = 1\n")], "repository string, position int, commit string, patch string")
    changes = readers.patch_lines(patches, keys=["repository", "position", "commit"], text="patch")
    intro = spark.createDataFrame([("r", "l1", "x.py", 1, "a = 1", 0), ("r", "l2", "x.py", 2, "b = compute(1)", 0), ("r", "l3", "x.py", 3, "tail", 0)], "repository string, line_id string, path string, line int, text string, position int")
    got = {(r.line_id, r.commit): (r.line, r.state) for r in lineage.replay(intro, changes).collect()}
    assert got == {("l1", "c1"): (1, "unchanged"), ("l2", "c1"): (2, "modified"), ("l3", "c1"): (5, "unchanged"), ("l1", "c2"): (1, "deleted"), ("l2", "c2"): (1, "modified"), ("l3", "c2"): (4, "unchanged")}


def test_shards_manifest_and_resume(spark, tmp_path):
    df = spark.range(50).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("task"), "id")
    writers.write_shards(df, str(tmp_path / "out"), digest="task", shards=4)
    back = spark.read.schema("task string, id long, shard int").json(str(tmp_path / "out"))
    assert back.count() == 50 and back.filter(F.col("shard") != writers.digest_shard(F.col("task"), 4)).count() == 0
    a, b = (writers.manifest(x.select("task", "id").withColumn("g", F.lit(1)), by=["g"], key="task").first() for x in (df, back))
    assert a == b
    assert writers.unfinished(df, df.filter("id < 40"), key="id", digest="task").count() == 10
    assert writers.differences(df, df.filter("id > 0")).count() == 1
    sizes = writers.packed(df.withColumn("g", F.lit(1)), by=["g"], order="id", size=F.lit(10), most_bytes=100).groupBy("file").count().collect()
    assert {r["count"] for r in sizes} == {10}
