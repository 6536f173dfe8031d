"""Where commits land on the main line of a commit graph.

The main line follows first parents from a head.  A commit lands at the earliest commit of
the line that it is an ancestor of.  Paths along first parents are walked by doubled
pointers, so a path of ``n`` commits takes ``log n`` joins; merges off the line
take one more turn for each level of nesting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.scratch import discard, materialize

#: A longer path of doubled pointers can only be a cycle.
MOST_DOUBLINGS = 48


def _doubled(pointers: DataFrame) -> DataFrame:
    """Pointers twice as long; those that would leave the graph are dropped."""
    ahead = pointers.select("repository", F.col("commit").alias("up"), F.col("up").alias("top"))
    return pointers.join(ahead, ["repository", "up"]).select("repository", "commit", F.col("top").alias("up"))


def main_line(first: DataFrame, heads: DataFrame) -> DataFrame:
    """``repository, commit, position`` of the first-parent path from each head; the oldest commit has position 0.

    ``first`` has ``repository, commit, up`` for every commit with a first parent.
    """
    line = materialize(heads.select("repository", "commit", F.lit(0).cast("long").alias("back")))
    pointers, step = first, 1
    for _ in range(MOST_DOUBLINGS):
        more = materialize(line.join(pointers, ["repository", "commit"]).select("repository", F.col("up").alias("commit"), (F.col("back") + step).alias("back")))
        if more.isEmpty():
            run = line.groupBy("repository").agg(F.max("back").alias("last"))
            return line.join(run, "repository").select("repository", "commit", (F.col("last") - F.col("back")).alias("position"))
        line, step = materialize(line.unionByName(more)), 2 * step
        pointers = materialize(_doubled(pointers))
    raise ValueError("first parents run in a cycle")


def landings(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """``repository, commit, landing, position`` of every commit; the last two are null where it never lands.

    ``parents``: repository, commit, parent, number (0 for the first parent; a root
    has one row with a null parent).  ``heads``: repository, commit.  Repeated rows count once.
    """
    edges = materialize(parents.select("repository", "commit", "parent", "number").distinct())
    first = edges.filter("number = 0 and parent is not null").select("repository", "commit", F.col("parent").alias("up"))
    line = materialize(main_line(first, heads.distinct()))
    on_line = line.select("repository", F.col("commit").alias("up"))
    off = first.join(line, ["repository", "commit"], "left_anti")
    # along first parents, but only off the line
    pointers = [materialize(off.join(on_line, ["repository", "up"], "left_anti").select("repository", "commit", "up"))]
    while not pointers[-1].isEmpty():
        if len(pointers) > MOST_DOUBLINGS:
            raise ValueError("first parents run in a cycle")
        pointers.append(materialize(_doubled(pointers[-1])))
    merged = edges.filter("number > 0 and parent is not null").join(on_line.withColumnRenamed("up", "parent"), ["repository", "parent"], "left_anti")
    merged = materialize(merged.select("repository", "commit", "parent"))
    lowest = F.min("position").alias("position")
    found, fresh = None, line
    while True:
        # what the newly labelled commits merge, then all that stands below it on first parents
        reached = merged.join(fresh, ["repository", "commit"]).groupBy("repository", F.col("parent").alias("commit")).agg(lowest)
        for step in pointers[:-1]:
            above = reached.join(step, ["repository", "commit"]).select("repository", F.col("up").alias("commit"), "position")
            reached = reached.unionByName(above).groupBy("repository", "commit").agg(lowest)
            reached = materialize(reached)
        if found is None:
            fresh = found = materialize(reached)
        else:
            known = found.withColumnRenamed("position", "known")
            fresh = materialize(reached.join(known, ["repository", "commit"], "left").filter("known is null or position < known").drop("known"))
            found = materialize(found.unionByName(fresh).groupBy("repository", "commit").agg(lowest))
        if fresh.isEmpty():
            break
    for table in pointers:
        discard(table)
    commits = edges.select("repository", "commit").union(edges.filter("parent is not null").select("repository", "parent")).distinct()
    where = line.select("repository", "commit", "position").unionByName(found)
    named = line.select("repository", "position", F.col("commit").alias("landing"))
    return commits.join(where, ["repository", "commit"], "left").join(named, ["repository", "position"], "left").select("repository", "commit", "landing", "position")
