"""Line lineage: what becomes of introduced lines over later commits.

What a removed line becomes depends on its commit alone, so it is found first, for all
commits at once: equal text by a join, similar text by comparing what is left inside its
hunk or commit.  Then lines are followed file by file.  A line leaves its file when
it moves or the file is renamed; those that leave enter their new file in the next
round.  The unit of work is a file (a large one is split by lines), not a
repository; there are as many rounds as a line changes files.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.scratch import discard, materialize

STATES = "repository string, line_id string, commit string, position int, path string, line int, state string"
#: A changed line is the same line modified from this similarity on, if the next best is at least MARGIN below.
LEAST, MARGIN, MOST_CANDIDATES = 0.8, 0.1, 2000
#: Lines of a file followed in one task, and pairs of texts compared in one.
FILE_LINES, PAIRS = 50_000, 200_000
GONE = "/dev/null"

_COMMIT = ["repository", "position", "commit"]


def _nearest(texts: list[str], added: list[tuple[str, int, str]]) -> list[tuple[str, int] | None]:
    """For each text the one added line that is near enough; None where there is none or more than one."""
    stripped = [t.strip() for t in texts]
    sizes = np.array([len(t) for t in stripped])
    best: list[tuple[float, tuple[str, int] | None]] = [(0.0, None)] * len(texts)
    second = [0.0] * len(texts)
    for path, line, other in added:
        other = other.strip()
        # the ratio is at most twice the shorter length over both
        possible = 2 * np.minimum(sizes, len(other)) >= (LEAST - MARGIN) * (sizes + len(other))
        matcher = difflib.SequenceMatcher(None, "", other)
        for i in np.flatnonzero(possible).tolist():
            matcher.set_seq1(stripped[i])
            if matcher.quick_ratio() < LEAST - MARGIN:
                continue
            ratio = matcher.ratio()
            if ratio > best[i][0]:
                second[i], best[i] = best[i][0], (ratio, (path, line))
            else:
                second[i] = max(second[i], ratio)
    return [to if ratio >= LEAST and ratio - s >= MARGIN else None for (ratio, to), s in zip(best, second, strict=True)]


def _similar(left: DataFrame, added: DataFrame) -> DataFrame:
    """``scope, text, found, to_path, to_line`` for each distinct text of a scope, among the added lines of that scope."""
    texts = left.select("scope", "text").distinct()
    sizes = texts.groupBy("scope").agg(F.count("*").alias("n")).join(added.groupBy("scope").agg(F.count("*").alias("m")), "scope")
    salts = sizes.select("scope", F.ceil(F.col("n") * F.col("m") / PAIRS).cast("int").alias("salts"))
    asked = texts.join(salts, "scope").select("scope", F.pmod(F.xxhash64("text"), F.col("salts")).cast("int").alias("salt"), "text")
    held = added.join(salts, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "path", "new_line", "text")

    # a scope is one row, so that many small ones travel to Python together
    key = ["scope", "salt"]
    ours = asked.groupBy(*key).agg(F.collect_list("text").alias("texts"))
    theirs = held.groupBy(*key).agg(F.collect_list(F.struct("path", "new_line", "text")).alias("added"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                found = _nearest(list(row.texts), [(a["path"], a["new_line"], a["text"]) for a in row.added])
                rows.extend((row.scope, text, *(hit or (None, None))) for text, hit in zip(row.texts, found, strict=True))
            yield pd.DataFrame(rows, columns=["scope", "text", "to_path", "to_line"]).astype({"scope": object, "text": object, "to_path": object, "to_line": "Int32"})

    return ours.join(theirs, key).mapInPandas(compare, "scope string, text string, to_path string, to_line int")


def removals(changes: DataFrame) -> DataFrame:
    """``repository, position, commit, old_path, path, old_line, fate, to_path, to_line`` of every removed line.

    A line is looked for among the lines that its own hunk adds; only if there are none,
    among those that the commit adds, of which at most ``MOST_CANDIDATES`` are compared.  If
    its text is added once there, it moves there (``unchanged``); else one similar added line
    makes it ``modified``; else it is ``unobservable``, or ``deleted`` if nothing is added or its file goes.
    """
    hunk = [*_COMMIT, "old_path", "path", "hunk"]
    removed = changes.filter("kind = 'removed'").select(*hunk, "old_line", "text")
    added = changes.filter("kind = 'added'").select(*hunk, "new_line", "text")

    def counted(by: list[str], n: str, same: str, to: str) -> tuple[DataFrame, DataFrame]:
        sizes = added.groupBy(*by).agg(F.count("*").alias(n))
        equal = added.groupBy(*by, "text").agg(F.count("*").alias(same), F.min(F.struct(F.col("path").alias("to_path"), F.col("new_line").alias("to_line"))).alias(to))
        return sizes, equal

    own_sizes, own_equal = counted(hunk, "n_own", "same_own", "to_own")
    all_sizes, all_equal = counted(_COMMIT, "n_all", "same_all", "to_all")
    met = removed.join(own_sizes, hunk, "left").join(own_equal, [*hunk, "text"], "left").join(all_sizes, _COMMIT, "left").join(all_equal, [*_COMMIT, "text"], "left")
    own = F.col("n_own").isNotNull()
    count, same, to = (F.when(own, F.col(f"{c}_own")).otherwise(F.col(f"{c}_all")) for c in ("n", "same", "to"))

    def scope(*parts: str) -> Column:
        return F.concat_ws("\0", *[F.col(p).cast("string") for p in parts])

    sized = met.select(*hunk, "old_line", "text", F.coalesce(count, F.lit(0)).alias("n"), F.coalesce(same, F.lit(0)).alias("same"), to.alias("to"), own.alias("own"))
    plain = (
        F.when(F.col("path") == GONE, "deleted").when(F.col("same") == 1, "unchanged").when(F.col("n") == 0, "deleted")
        .when((F.col("same") > 1) | (~F.col("own") & (F.col("n") > MOST_CANDIDATES)), "unobservable")
    )
    sized = materialize(sized.withColumn("fate", plain).withColumn("scope", F.when(F.col("own"), scope(*hunk)).otherwise(scope(*_COMMIT))))
    left = sized.filter("fate is null")
    inside = added.select(scope(*hunk).alias("scope"), "path", "new_line", "text").join(left.filter("own").select("scope").distinct(), "scope", "left_semi")
    across = added.select(scope(*_COMMIT).alias("scope"), "path", "new_line", "text").join(left.filter("not own").select("scope").distinct(), "scope", "left_semi")
    near = _similar(left, inside.unionByName(across))
    keys = [*_COMMIT, "old_path", "path", "old_line"]
    told = sized.filter("fate is not null").select(*keys, "fate", F.when(F.col("fate") == "unchanged", F.col("to.to_path")).alias("to_path"), F.when(F.col("fate") == "unchanged", F.col("to.to_line")).alias("to_line"))
    rest = left.join(near, ["scope", "text"]).select(*keys, F.when(F.col("to_line").isNotNull(), "modified").otherwise("unobservable").alias("fate"), "to_path", "to_line")
    return told.unionByName(rest)


def _by_file(changes: DataFrame) -> DataFrame:
    """One row a changed file: its new path, its removed lines with their fates, and the lines added to the new path, in order."""
    file = [*_COMMIT, "old_path"]
    fates = removals(changes).groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("old_line", "fate", "to_path", "to_line"))).alias("removed"))
    paths = changes.groupBy(*file).agg(F.max("path").alias("path"))
    lines = changes.filter("kind = 'added'").groupBy(*_COMMIT, "path").agg(F.array_sort(F.collect_list("new_line")).alias("added"))
    return paths.join(fates, file, "left").join(lines, [*_COMMIT, "path"], "left")


def _advance(repository: str, file: str, lines: list[dict], changes: list[dict]) -> Iterator[tuple]:
    """The states of the lines of one file after each of its changes (``STATES`` and ``moved``, where a line goes on in another file)."""
    at, since = np.array([x["line"] for x in lines], np.int64), np.array([x["since"] for x in lines], np.int64)
    ids, state = [x["line_id"] for x in lines], [x["state"] for x in lines]
    here = np.ones(len(lines), bool)
    for change in sorted(changes, key=lambda c: (c["position"], c["commit"])):
        own = np.flatnonzero(here & (since < change["position"]))
        if not len(own):
            if not here.any():
                break
            continue
        fates = [] if change["removed"] is None else list(change["removed"])
        removed = np.array([f["old_line"] for f in fates], np.int64)
        added = np.array([] if change["added"] is None else change["added"], np.int64)
        before = np.searchsorted(removed, at[own])
        # the k-th line that stays is the k-th one of the new file that is not added
        kept = at[own] - before
        line = kept + np.searchsorted(added - np.arange(len(added)), kept, side="right")
        for i, k in enumerate(own.tolist()):
            place, path = int(line[i]), change["path"]
            if before[i] < len(removed) and removed[before[i]] == at[k]:
                fate = fates[before[i]]
                if fate["fate"] != "unchanged":
                    state[k] = fate["fate"]
                if fate["to_path"] is None:
                    place, path = int(at[k]), file
                    here[k] = False
                else:
                    place, path = fate["to_line"], fate["to_path"]
            at[k] = place
            moved = bool(here[k] and path != file)
            here[k] &= not moved
            yield repository, ids[k], change["commit"], change["position"], path, place, state[k], moved


def _advanced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`_advance` of every row (a file with its lines and changes)."""
    names = ["repository", "line_id", "commit", "position", "path", "line", "state", "moved"]
    for frame in frames:
        for i in range(0, len(frame), 1000):
            rows = [r for f in frame.iloc[i : i + 1000].itertuples() for r in _advance(f.repository, f.path, list(f.lines), list(f.changes))]
            yield pd.DataFrame(rows, columns=names).astype({n: object for n in ("repository", "line_id", "commit", "path", "state")})


def replay(introduced: DataFrame, changes: DataFrame) -> DataFrame:
    """State of every introduced line after each commit that touches its file.

    ``introduced``: repository, line_id, path, line, text, position (of the
    commit that made it).  ``changes``: repository, position, commit, and the
    rows of :func:`sedimenta.sources.readers.patch_lines`.  The fate of a removed line is
    that of :func:`removals`; other lines shift.  Ends are final.
    """
    touched = materialize(changes.join(introduced.select("repository").distinct(), "repository", "left_semi"))
    files = materialize(_by_file(touched).withColumnRenamed("path", "new_path"))
    discard(touched)
    entered = materialize(introduced.selectExpr("repository", "line_id", "path", "cast(line as int) line", "cast(position as int) since", "'unchanged' state"))
    rounds: list[DataFrame] = []
    pruned = entered.count()
    while True:
        key = ["repository", "path"]
        salts = entered.groupBy(*key).agg(F.ceil(F.count("*") / FILE_LINES).cast("int").alias("salts"))
        lines = entered.join(salts, key).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.col("salts")).cast("int"))
        lines = lines.groupBy(*key, "salt").agg(F.collect_list(F.struct("line_id", "line", "since", "state")).alias("lines"))
        met = files.withColumnRenamed("old_path", "path").join(salts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = met.groupBy(*key, "salt").agg(F.collect_list(F.struct("position", "commit", F.col("new_path").alias("path"), "removed", "added")).alias("changes"))
        # a file is one row, so that many small ones travel to Python together
        rounds.append(materialize(lines.join(met, [*key, "salt"]).mapInPandas(_advanced, f"{STATES}, moved boolean")))
        entered = rounds[-1].filter("moved").selectExpr("repository", "line_id", "path", "line", "position since", "state")
        left = entered.count()
        if not left:
            break
        if 2 * left <= pruned:
            # later rounds read the changes that the lines still on their way can meet
            still = entered.groupBy("repository").agg(F.min("since").alias("__since"))
            fewer = materialize(files.join(still, "repository").filter("position > __since").drop("__since"))
            discard(files)
            files, pruned = fewer, left
    discard(files)
    out = rounds[0]
    for one in rounds[1:]:
        out = out.unionByName(one)
    return out.drop("moved")
