"""Readers for code-history inputs: JSON lines, TSV maps, git logs, numstat, patches and blame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.functions.paths import is_skipped
from sedimenta.functions.paths import language as language_of


def json_lines(spark: SparkSession, path: str, schema: StructType | str, *, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema; the plain file wins over ``.gz``; a missing file gives an empty frame."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    for candidate in (path, f"{path}.gz"):
        place = spark._jvm.org.apache.hadoop.fs.Path(candidate)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(schema).option("mode", mode).json(candidate)
    return spark.createDataFrame([], schema)


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def tsv_map(spark: SparkSession, path: str, *, key: str, value: str) -> DataFrame:
    """A two-column TSV as a map; of repeated keys the last line wins."""
    lines = spark.read.option("wholetext", True).text(path)
    rows = lines.select(F.posexplode(F.split("value", "\n")).alias("i", "line")).filter(F.col("line").contains("\t"))
    parts = F.split("line", "\t")
    return rows.groupBy(parts[0].alias(key)).agg(F.max_by(parts[1], F.col("i")).alias(value))


def git_log(spark: SparkSession, path: str, *, fields: list[str]) -> DataFrame:
    """Commits of a log written with records ended by 0x1e and fields parted by NUL."""
    raw = spark.read.option("lineSep", "\x1e").text(path)
    parts = F.split(F.regexp_replace("value", r"^\s+", ""), "\0")
    rows = raw.filter(F.trim("value") != "").select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f) for i, f in enumerate(fields)])
    return rows


def numstat(history: DataFrame, *, key: str, text: str) -> DataFrame:
    """``(key, added, deleted, path)`` from one numstat block a row; binary counts are null."""
    lines = history.select(key, F.explode(F.split(text, "\n")).alias("line"))
    hit = lines.select(key, F.regexp_extract("line", r"^(\d+|-)\t(\d+|-)\t(.+)$", 0).alias("all"), F.split("line", "\t", 3).alias("p")).filter("all <> ''")
    number = lambda x: F.when(x != "-", x.cast("long"))
    return hit.select(key, number(F.col("p")[0]).alias("added"), number(F.col("p")[1]).alias("deleted"), renamed_to(F.col("p")[2]).alias("path"))


def renamed_to(path):
    """The destination of a rename written as ``a/{b => c}/d`` or ``a => b``."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.regexp_replace(braces, r"^.* => ", "")


#: The first row of a line in blame output.
HEAD = re.compile(r"^[0-9a-f]{40} \d+ \d+")
_CHANGE = "old_path string, path string, hunk int, kind string, old_line int, new_line int, text string"


def patch_lines(patches: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """One row for each added or removed line of unified diffs, with its line numbers before and after.

    ``hunk`` numbers the hunks of a diff from 1.
    """
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in patches.select(*keys).schema], _CHANGE])

    def parse(patch: str | None) -> Iterator[tuple]:
        old = new = ""
        o = n = left_o = left_n = hunk = 0
        for line in (patch or "").split("\n"):
            if left_o or left_n:
                mark, body = line[:1], line[1:]
                if mark == "+":
                    yield old, new, hunk, "added", None, n, body
                    n, left_n = n + 1, left_n - 1
                elif mark == "-":
                    yield old, new, hunk, "removed", o, None, body
                    o, left_o = o + 1, left_o - 1
                elif mark != "\\":
                    o, n, left_o, left_n = o + 1, n + 1, left_o - 1, left_n - 1
            elif line.startswith("--- "):
                old = line[4:].removeprefix("a/")
            elif line.startswith("+++ "):
                new = line[4:].removeprefix("b/")
            elif line.startswith("@@ "):
                hunk += 1
                before, after = line.split(" ")[1:3]
                o, left_o = (int(x) for x in (before[1:].split(",") + ["1"])[:2])
                n, left_n = (int(x) for x in (after[1:].split(",") + ["1"])[:2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[*key, *change] for *key, patch in batch[[*keys, text]].itertuples(index=False) for change in parse(patch)]
            out = pd.DataFrame(rows, columns=[*keys, "old_path", "path", "hunk", "kind", "old_line", "new_line", "text"])
            yield out.astype({"old_line": "Int32", "new_line": "Int32"})

    return patches.select(*keys, text).mapInPandas(run, schema)


def added_lines(patches: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """Added non-blank lines with their path, number and content digest."""
    rows = patch_lines(patches, keys=keys, text=text).filter((F.col("kind") == "added") & F.col("text").rlike(r"\S"))
    return rows.select(*keys, "path", "new_line", "text", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))


def blame_lines(files: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """``(keys, line, commit, text)`` of blame output in the porcelain form that heads every line."""
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keys).schema], "line int, commit string, text string"])

    def parse(blame: str | None) -> Iterator[tuple]:
        commit, number = "", 0
        for row in (blame or "").split("\n"):
            if row.startswith("\t"):
                yield number, commit, row[1:]
            elif HEAD.match(row):
                commit, _, place = row.split(" ")[:3]
                number = int(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[*key, *line] for *key, blame in batch[[*keys, text]].itertuples(index=False) for line in parse(blame)]
            yield pd.DataFrame(rows, columns=[*keys, "line", "commit", "text"]).astype({"line": "int32"})

    return files.select(*keys, text).mapInPandas(run, schema)


def name_status(diffs: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """``(keys, status, old_path, path)`` of name-status lists; a rename or copy has both paths, with or without changed lines."""
    lines = diffs.select(*keys, F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike(r"^[ACDMRT]\d*\t"))
    p = F.split("line", "\t")
    return lines.select(*keys, F.substring(p[0], 1, 1).alias("status"), p[1].alias("old_path"), F.coalesce(F.get(p, F.lit(2)), p[1]).alias("path"))


def kept_history(counts: DataFrame, *, key: str, language: str) -> DataFrame:
    """Numstat rows in one language, vendored paths and commits without changed lines left out."""
    own = counts.filter((language_of(F.col("path")) == language) & ~is_skipped(F.lower("path")))
    total = own.groupBy(key).agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("__n")).filter("__n > 0")
    return own.join(total.select(key), key, "left_semi")


def blame_hunks(lines: DataFrame, *, keys: list[str]) -> DataFrame:
    """Runs of consecutive lines of one commit, from ``(keys, line, commit)``."""
    from sedimenta.operators.sequence import islands

    return islands(lines, by=keys, position="line", same=["commit"])


def diff_counts(changes: DataFrame, *, keys: list[str]) -> DataFrame:
    """Files, added and removed lines of each key."""
    return changes.groupBy(*keys).agg(
        F.count_distinct("path").alias("files"),
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "removed").alias("removed"),
    )


def ordered_commits(commits: DataFrame, *, repository: str, at: str, commit: str) -> DataFrame:
    """Adds ``position`` in (time, id) order of each repository."""
    return commits.withColumn("position", F.row_number().over(W.partitionBy(repository).orderBy(at, commit)))
