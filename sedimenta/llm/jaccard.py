"""Exact n-gram Jaccard join of whole texts, through a token-group matrix.

1.  A shingle links documents only if two hold it, so every document learns
    which of its shingles others hold (:mod:`exchange`).  A document of ``n``
    shingles of which fewer than ``0.75 n`` are shared has no link; of the
    others only the shared ones matter from here on.
2.  Equal sets become one row, their smallest id.
3.  Rows are partitioned into groups of similar ones: each follows the smallest
    row, by shingles and then id, that shares a minimum hash with it and agrees
    in ``LOOSE`` of its minimum hashes.  Groups are only a partition; being in
    one links nothing.
4.  Groups are opened, a unit of at most about ``unit_rows`` rows a task: exact
    overlaps from the unit's inverted index, and edges only where they join what
    was not joined before.  A group of several units has its leader in each.
5.  The token-group matrix holds each group's token union, a row for each group and
    shingle.  The overlap of a query row with all other groups is bounded by its
    shingles that they hold; below ``0.75 n`` no other group needs to be opened for
    it.  For the few rows left, shingles are ordered by the number of groups that
    hold them, and a row asks the groups that share one of the first
    ``bound - 0.75 n + 1`` (a prefix under a common order, so exact).  The bound is
    taken again against the union of the group asked, which is opened only if it
    holds.  This is done twice: first each shingle names one group only, so that
    what links in chains or stars becomes one group with work in proportion to its
    rows; then the groups that are left meet all others.
6.  Components of all edges.

Nothing is dropped by frequency or size.  A component that spans units counts as
one group in step 5, so a mass of near copies costs in proportion to its rows.

Defined results: null and empty texts, and texts without words, have no shingles
and stand alone; a text of fewer words than a shingle has its whole sequence as
its one shingle; rows without an id stand alone with a null component; rows
repeated under one id are one node, and each returns a row.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import exchange
from sedimenta.llm.components import components
from sedimenta.llm.shingles import shingles
from sedimenta.plans.scratch import discard, materialize, release, small_batches

#: Minimum hashes of a row, and the share that must agree for one group.
HASHES, LOOSE = 16, 0.4
_MULTIPLIERS = np.random.default_rng(11).integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Index entries that a task reads at once.
AT_ONCE = 1 << 21
_SIGNED = "id long, n long, toks array<long>, mins array<long>"


def need(n, percent: int):
    """Least overlap that a row of ``n`` shingles must have with any partner."""
    return -(-n * percent // 100)


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, toks, mins``: set size of every row; shared shingles and minimum hashes where a link is possible."""
    blocks, slice_bits = exchange.planned(docs, "text")
    bits = 48 + slice_bits - 8
    drop = np.uint64(max(0, 56 - bits))
    placed = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(sets) >> drop if sets else np.empty(0, np.uint64)

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, words) for t in rows["text"]]
        k, counts = np.unique(keys(sets), return_counts=True)
        return exchange.send(rows["block"].iloc[0], k, counts, bits, slice_bits)

    def judge(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, words) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        _, which = np.unique(keys(sets), return_inverse=True)
        several = exchange.received(back)[which] > 1
        shared = np.split(several, np.cumsum(sizes)[:-1]) if len(sizes) else []
        toks: list[np.ndarray | None] = []
        mins: list[np.ndarray | None] = []
        for s, keep in zip(sets, shared, strict=True):
            if len(s) and keep.sum() >= need(len(s), percent):
                own = s[keep]
                toks.append(own.astype(np.int64))
                mins.append(((own[:, None] * _MULTIPLIERS) >> np.uint64(2)).min(axis=0).astype(np.int64))
            else:
                toks.append(None)
                mins.append(None)
        return pd.DataFrame({"id": rows["id"].astype("Int64"), "n": sizes, "toks": pd.Series(toks, dtype=object, index=rows.index), "mins": pd.Series(mins, dtype=object, index=rows.index)})

    sent = placed.groupBy("block").applyInPandas(emit, exchange.SENT)
    back = exchange.totals(sent, bits, slice_bits)
    return placed.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(judge, _SIGNED)


def _held(toks: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``toks`` are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(toks), bool)
    return among[np.minimum(np.searchsorted(among, toks), len(among) - 1)] == toks


class _Sets:
    """Disjoint sets over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.left = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a
            self.left -= 1
        return a != b


def links(sizes: np.ndarray, sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that join all links among ``sets`` into trees.

    ``sizes`` are the full set sizes; the sets may lack elements that no other
    set has.  With ``sides``, only pairs of unlike sides are compared.
    """
    n = len(sets)
    joined, out = _Sets(n), []
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    postings, count = owner[order], np.bincount(token)
    start = np.cumsum(count) - count
    first = np.cumsum([0] + [len(s) for s in sets])
    for a in range(n - 1):
        if joined.left == 1:
            break
        own = token[first[a] : first[a + 1]]
        own = own[count[own] > 1]
        overlap = np.zeros(n, np.int64)
        for some in np.array_split(own, 1 + int(count[own].sum()) // AT_ONCE):
            lens = count[some]
            at = np.repeat(start[some] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            overlap += np.bincount(postings[at], minlength=n)
        linked = 100 * overlap >= percent * (sizes[a] + sizes - overlap)
        linked[: a + 1] = False
        if sides is not None:
            linked &= sides != sides[a]
        out += [(a, int(b)) for b in np.flatnonzero(linked) if joined.join(a, int(b))]
    return out


def near_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    unit_rows: int = 1024,
) -> DataFrame:
    """``id, n, component`` of every row: shingles and the smallest id reachable by links of ``percent`` or more."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(_signed(rows, words, percent))
    release(spark)

    # 2. equal sets; only a row whose every shingle is shared can have an equal
    able = signed.filter(F.col("toks").isNotNull() & F.col("id").isNotNull())
    whole = F.size("toks") == F.col("n")
    keyed = able.select(
        "id", "n", "mins", whole.alias("whole"),
        F.when(whole, F.xxhash64("toks")).otherwise(F.col("id")).alias("k1"),
        F.when(whole, F.xxhash64(F.lit(1), "toks")).otherwise(F.lit(0)).alias("k2"),
    )
    key = ["n", "whole", "k1", "k2"]
    reps = keyed.groupBy(*key).agg(F.min("id").alias("rep"), F.min_by("mins", "id").alias("mins"))
    reps = materialize(reps)
    member = materialize(keyed.select("id", *key).join(reps.select(*key, "rep"), key).select("id", "rep").distinct())

    # 3. groups of similar rows
    step = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    sketch = reps.select("rep", "n", "mins", step.alias("step"))
    posted = sketch.select("rep", "n", "mins", "step", F.posexplode("mins").alias("pos", "low"))
    heads = posted.groupBy("pos", "low", "step").agg(F.min(F.struct("n", "rep", "mins")).alias("head"))
    asked = posted.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") - 1)))
    agree = F.size(F.filter(F.arrays_zip("mins", F.col("head.mins").alias("theirs")), lambda x: x["mins"] == x["theirs"]))
    follow = (
        asked.join(heads, ["pos", "low", "step"])
        .filter((F.struct(F.col("head.n"), F.col("head.rep")) < F.struct("n", "rep")) & (agree >= LOOSE * HASHES))
        .groupBy("rep")
        .agg(F.min(F.struct(F.col("head.n").alias("n"), F.col("head.rep").alias("rep"))).alias("h"))
        .select("rep", F.col("h.rep").alias("grp"))
    )
    first = materialize(sketch.select("rep").join(follow, "rep", "left").select("rep", F.coalesce("grp", "rep").alias("grp")))
    second = first.select(F.col("rep").alias("grp"), F.col("grp").alias("head"))
    grouped = first.join(second, "grp").select("rep", F.col("head").alias("grp"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size")).withColumn("units", F.ceil(F.col("size") / unit_rows).cast("int"))
    assigned = grouped.join(sizes, "grp").withColumn("unit", F.pmod(F.xxhash64("rep"), F.col("units")).cast("int"))
    nodes = materialize(able.select(F.col("id").alias("rep"), "n", "toks").join(assigned, "rep"))
    sized = materialize(signed.select("id", "n"))
    discard(signed, reps, first)
    release(spark)

    # 4. open each group, several small ones in a frame
    def open_units(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in frame.groupby(["grp", "unit"]):
            rows = rows.drop_duplicates("rep").sort_values("n")
            ids = rows["rep"].to_numpy()
            out += [(ids[a], ids[b]) for a, b in links(rows["n"].to_numpy(), [t.astype(np.int64) for t in rows["toks"]], percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    several = nodes.filter("size > 1")
    leaders = several.filter("units > 1 and rep = grp").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    packs = -(-several.count() // (4 * unit_rows)) or 1
    pack = F.pmod(F.xxhash64("grp", "unit"), F.lit(packs))
    edges = materialize(several.unionByName(leaders).select("grp", "unit", "rep", "n", "toks").groupBy(pack).applyInPandas(open_units, "a long, b long"))
    inner = components(edges)
    discard(edges)
    release(spark)

    # 5. other groups, where the bound allows a link: first one group a token, then all that are left
    placed = _homes(nodes.select("rep", F.xxhash64("grp", "unit").alias("home")).distinct(), inner)
    rows = nodes.select("rep", "n", "toks").dropDuplicates(["rep"])
    first_edges, kept = _cross(rows, placed, percent, unit_rows, hub=True)
    joined = components(first_edges.union(inner.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    again = _homes(placed, joined)
    release(spark)
    more, kept_again = _cross(kept.select("rep", "n", "toks"), again, percent, unit_rows, hub=False)

    # 6. components of everything
    final = joined if more.isEmpty() else components(more.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    of = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = materialize(sized.join(of, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component")))
    discard(sized, member, nodes, inner, placed, first_edges, kept, joined, again, more, kept_again, *([] if final is joined else [final]))
    return out


def _homes(placed: DataFrame, joined: DataFrame) -> DataFrame:
    """``rep, home``: as before, but one home of its own for a component that spans several."""
    of = placed.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spans = of.groupBy("component").agg((F.min("home") != F.max("home")).alias("spans"))
    return materialize(of.join(spans, "component").select("rep", F.when(F.col("spans"), F.xxhash64(F.lit("c"), "component")).otherwise(F.col("home")).alias("home")))


def _cross(rows: DataFrame, placed: DataFrame, percent: int, unit_rows: int, *, hub: bool) -> tuple[DataFrame, DataFrame]:
    """Links between rows of different homes, and the rows (``rep, n, toks``) that may have one.

    A home of more than ``unit_rows`` rows is split into parts by hash.  A row asks
    the parts of other homes that hold one of its first ``bound - need + 1`` tokens
    in order of rarity among their own first ones; with ``hub``, only the first home
    of each token.
    """
    homed = rows.join(placed, "rep")
    parts = homed.groupBy("home").agg(F.ceil(F.count("*") / unit_rows).cast("int").alias("parts"))
    at = materialize(homed.join(parts, "home").select("home", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep", "n", "toks"))
    # the token-group matrix: the token union of every part
    matrix = materialize(at.select("home", "part", F.explode("toks").alias("tok")).distinct())
    held = matrix.groupBy("tok").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count("*").alias("parts")).filter("lo <> hi").select("tok", "parts")

    # several homes share a task's frame, as each frame has a cost of its own; a home's part is in one of them
    packs = -(-at.count() // (4 * unit_rows)) or 1
    pack = F.pmod(F.xxhash64("home", "part"), F.lit(packs)).alias("pack")

    def able(frame: pd.DataFrame, cross: pd.DataFrame) -> pd.DataFrame:
        """Rows with enough tokens that other homes hold, those tokens rarest first, and how many of them come first."""
        cross = cross.sort_values("tok")
        toks, held_by = cross["tok"].to_numpy(np.int64), cross["parts"].to_numpy(np.int64)
        at_home = cross.groupby(["home", "part"]).indices
        reps, sizes, sets = frame["rep"].to_numpy(), frame["n"].to_numpy(), frame["toks"].to_numpy()
        kept: list[tuple] = []
        for (home, part), members in frame.groupby(["home", "part"]).indices.items():
            if (home, part) not in at_home:
                continue
            own_at = at_home[home, part]
            tok, by = toks[own_at], held_by[own_at]
            for i in members:
                own = sets[i][_held(sets[i], tok)]
                if len(own) and len(own) >= (least := need(sizes[i], percent)):
                    kept.append((home, part, reps[i], sizes[i], own[np.lexsort((own, by[np.searchsorted(tok, own)]))], len(own) - least + 1))
        return pd.DataFrame(kept, columns=["home", "part", "rep", "n", "toks", "first"])

    key = ["home", "part"]
    cross = matrix.join(held, "tok").select("*", pack)
    kept = materialize(at.select("*", pack).groupBy("pack").cogroup(cross.groupBy("pack")).applyInPandas(able, "home long, part int, rep long, n long, toks array<long>, first int"))
    discard(at, matrix)

    first = kept.select(*key, "n", F.explode(F.slice("toks", F.lit(1), F.col("first"))).alias("tok"))
    posts = materialize(first.groupBy("tok", *key).agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    theirs = posts.select("tok", F.col("home").alias("home2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    if hub:
        theirs = theirs.groupBy("tok").agg(F.min(F.struct("home2", "part2", "lo2", "hi2")).alias("h")).select("tok", "h.*")
    fits = (100 * F.col("hi2") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("lo2"))
    pairs = posts.join(theirs, "tok").filter((F.col("home2") != F.col("home") if hub else F.col("home2") < F.col("home")) & fits).select(*key, "tok", "home2", "part2")

    def ask(frame: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """Each row once for every part that holds one of its first tokens."""
        out = []
        toks, firsts = frame["toks"].to_numpy(), frame["first"].to_numpy()
        members = frame.groupby(["home", "part"]).indices
        for (home, part, home2, part2), some in met.groupby(["home", "part", "home2", "part2"]):
            tok = np.sort(some["tok"].to_numpy(np.int64))
            asks = [i for i in members[home, part] if _held(toks[i][: firsts[i]], tok).any()]
            out.append(frame.iloc[asks][["rep", "n", "toks"]].assign(home2=home2, part2=part2))
        return pd.concat(out) if out else frame.iloc[:0][["rep", "n", "toks"]].assign(home2=0, part2=0)

    asked = kept.select("*", pack).groupBy("pack").cogroup(pairs.select("*", pack).groupBy("pack")).applyInPandas(ask, "rep long, n long, toks array<long>, home2 long, part2 int")
    asked = materialize(asked)
    opened = asked.groupBy("home2", "part2").agg(F.ceil(F.count("*") / (4 * unit_rows)).cast("int").alias("chunks"))
    columns = ["home2", "part2", "chunk", "side", "rep", "n", "toks"]
    mine = asked.join(opened, ["home2", "part2"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int")).withColumn("side", F.lit(0))
    other = kept.withColumnsRenamed({"home": "home2", "part": "part2"}).join(opened, ["home2", "part2"])
    other = other.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1))

    def open_part(frame: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows that ask and the part's own, of those rows that its token union allows one."""
        side = frame["side"].to_numpy()
        union = np.unique(np.concatenate([np.empty(0, np.int64), *frame["toks"][side == 1]]))
        bound = np.array([_held(t, union).sum() for t in frame["toks"]])
        frame = frame[(side == 1) | (bound >= need(frame["n"].to_numpy(), percent))].sort_values("n")
        found = links(frame["n"].to_numpy(), [t.astype(np.int64) for t in frame["toks"]], percent, frame["side"].to_numpy())
        ids = frame["rep"].to_numpy()
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"], dtype="int64")

    edges = materialize(mine.select(*columns).unionByName(other.select(*columns)).groupBy("home2", "part2", "chunk").applyInPandas(open_part, "a long, b long"))
    discard(posts, asked)
    return edges, kept


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS tok FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = n.doc_id) AS component_id FROM n
"""
