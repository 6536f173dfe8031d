"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to cells, the nearest of a few centres taken from a bounded
sample, and a cell of more than ``part_rows`` rows is split by a hash of the id.
Queries go in blocks of about ``block_queries`` to every part that may hold one
of their k best, and a part goes only to blocks with such a query.  In a task both sides get a cover tree: each node has a centre,
a covering radius and children whose centres are farther apart than the radius
of the children's level.  Node pairs are visited best bound first; by

    <q, r>  <=  <cq, cr> + rq |cr| + rr |cq| + rq rr

a pair is dropped when it can't reach the worst k-th score of the query node's
queries.  The first k-th scores come from the sample, which can only be too low,
so nothing that belongs to the result is dropped; a cell is skipped for a query
by the same bound.

Scores are integers and exact: products are summed in double precision while
all partial sums stay below 2^53, else as 64-bit integers.

Defined results: null, empty and non-finite vectors, and rows without an id,
take no part (zero vectors do); only vectors of equal length are compared; rows
with one id count as one candidate, at its highest score; fewer candidates than
k are all returned; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.vectors import best, usable
from sedimenta.plans.scratch import materialize

SHRINK, LEAF = 0.7, 48


@dataclass
class Node:
    """A cover-tree node; a leaf holds row positions, an inner node children."""

    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, at: int | None = None, reach: np.ndarray | None = None) -> Node:
    """Tree over ``points[rows]``; children cover their rows within ``SHRINK`` times the node's radius."""
    if rows is None:
        rows = np.arange(len(points))
    if at is None:
        at = int(rows[0])
    if reach is None:
        reach = np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1))
    node = Node(points[at], float(np.linalg.norm(points[at])), float(reach.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    level = node.radius * SHRINK
    owner, near = np.zeros(len(rows), int), reach.copy()
    centres = [at]
    while near.max() > level:
        far = int(near.argmax())
        d = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(axis=1))
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
        centres.append(int(rows[far]))
    loose: list[int] = []
    for c, centre in enumerate(centres):
        own = np.flatnonzero(owner == c)
        if len(own) > 3:
            node.children.append(cover_tree(points, rows[own], centre, near[own]))
        else:
            loose += own.tolist()
    # single points far from all others share leaves, so that leaves stay worth a matrix product
    for i in range(0, len(loose), LEAF):
        some = rows[loose[i : i + LEAF]]
        mid = points[some].mean(axis=0)
        r = float(np.sqrt(((points[some] - mid) ** 2).sum(axis=1)).max())
        node.children.append(Node(mid, float(np.linalg.norm(mid)), r, some))
    return node


class DualTree:
    """The k best rows of every query, kept while node pairs are visited."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
        self.q, self.qid, self.r, self.rid, self.k = queries.astype(np.float64), query_ids, rows.astype(np.float64), ids, k
        bound = np.abs(self.q).max(initial=0) * np.abs(self.r).max(initial=0) * self.q.shape[1]
        self.whole = (self.q, self.r) if bound < 2**53 else (queries.astype(np.int64), rows.astype(np.int64))
        self.kth = floor.astype(np.float64).copy()
        self.scores = [np.empty(0, np.int64)] * len(queries)
        self.found = [np.empty(0, np.int64)] * len(queries)
        self.slack = 1e-9 * (1 + bound)

    def bound(self, a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + self.slack

    def run(self) -> None:
        top, all_rows = cover_tree(self.q), cover_tree(self.r)
        stack = [(self.bound(top, all_rows), top, all_rows)]
        while stack:
            bound, a, b = stack.pop()
            if bound < self.kth[a.rows].min():
                continue
            if not a.children and not b.children:
                self._leaves(a, b)
                continue
            open_a = a.children and (not b.children or len(a.rows) * b.radius < len(b.rows) * a.radius)
            pairs = [(x, b) for x in a.children] if open_a else [(a, x) for x in b.children]
            # the stack gives back the highest bound first
            stack += sorted(((self.bound(x, y), x, y) for x, y in pairs), key=lambda p: p[0])

    def _leaves(self, a: Node, b: Node) -> None:
        q, r = self.whole
        scores = (q[a.rows] @ r[b.rows].T).astype(np.int64)
        ids = self.rid[b.rows]
        hits = scores >= self.kth[a.rows][:, None]
        for i in np.flatnonzero(hits.any(axis=1)):
            at = a.rows[i]
            keep = hits[i] & (ids != self.qid[at])
            if not keep.any():
                continue
            s = np.concatenate((self.scores[at], scores[i][keep]))
            f = np.concatenate((self.found[at], ids[keep]))
            order = np.lexsort((f, -s))
            s, f = s[order], f[order]
            first = np.sort(np.unique(f, return_index=True)[1])[: self.k]
            self.scores[at], self.found[at] = s[first], f[first]
            if len(first) == self.k:
                self.kth[at] = max(self.kth[at], self.scores[at][-1])


def scaled(vec: Column, by: float) -> Column:
    """Array of ``floor(by * x)`` as long, x as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(by)) * x.cast("double")))


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, each the farthest from those before."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _search_dim(base: DataFrame, asked: DataFrame, dim: int, k: int, cells: int, sample_rows: int, part_rows: int, block_queries: int) -> DataFrame:
    sc = base.sparkSession.sparkContext
    # a bounded sample: sample_rows rows of lowest hash, distinct by id
    key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    most = min(1.0, 4 * sample_rows / max(1, base.count())) * (1 << 40)  # cut first, so that tasks send little to the sort
    sample = {r.vec_id: r.vec for r in base.filter(key < most).orderBy(key, "vec_id").limit(sample_rows).collect()}
    if not sample:
        sample = {r.vec_id: r.vec for r in base.limit(1).collect()}
    s_ids, s_vec = np.array(list(sample), np.int64), np.array(list(sample.values()), np.float64).reshape(-1, dim)
    shared = sc.broadcast((s_ids, s_vec, _centres(s_vec, cells)))

    @F.pandas_udf("struct<cell:int,reach:double>")
    def place(vecs: pd.Series) -> pd.DataFrame:
        v, centres = np.array(vecs.tolist(), np.float64).reshape(-1, dim), shared.value[2]
        d = ((v * v).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * v @ centres.T).clip(0)
        cell = d.argmin(axis=1)
        # measured again directly, as the radius must cover
        reach = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": reach})

    placed = base.withColumn("p", place("vec")).select("vec_id", "vec", "p.cell", "p.reach")
    stats = placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
    radius = np.full(len(shared.value[2]), -1.0)
    for r in stats:
        radius[r.cell] = r.radius
    parts = {r.cell: -(-r.n // part_rows) for r in stats}
    radii = sc.broadcast(radius)

    @F.pandas_udf("struct<floor:double,cells:array<int>>")
    def aim(ids: pd.Series, vecs: pd.Series) -> pd.DataFrame:
        s_ids, s_vec, centres = shared.value
        q = np.array(vecs.tolist(), np.float64).reshape(-1, dim)
        scores = q @ s_vec.T
        scores[ids.to_numpy()[:, None] == s_ids[None]] = -np.inf
        floor = np.full(len(q), -np.inf)
        if len(s_ids) >= k:
            floor = np.partition(scores, len(s_ids) - k, axis=1)[:, len(s_ids) - k]
        norm = np.linalg.norm(q, axis=1)
        reach = q @ centres.T + radii.value[None] * norm[:, None]
        slack = 1e-9 * (1 + np.abs(reach))
        ok = (reach + slack >= floor[:, None]) & (radii.value[None] >= 0)
        return pd.DataFrame({"floor": floor, "cells": pd.Series([np.flatnonzero(r).astype("int32") for r in ok], dtype=object)})

    n_blocks = max(1, -(-asked.count() // block_queries))
    in_cell = F.create_map(*[F.lit(x) for c, n in sorted(parts.items()) for x in (c, n)])
    key = ["cell", "part", "block"]
    aimed = (
        asked.withColumn("a", aim("query_id", "vec"))
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        .select("query_id", "vec", "block", "a.floor", F.explode("a.cells").alias("cell"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(in_cell, F.col("cell")) - 1)))
    )
    aimed = materialize(aimed)
    # a part goes only to the blocks of which a query aims at it
    wanted = aimed.select(F.col("cell").alias("__cell"), F.col("part").alias("__part"), F.col("block").alias("__block")).distinct()
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.element_at(in_cell, F.col("cell"))).cast("int")
    dealt = placed.withColumn("part", part).join(wanted, (F.col("cell") == F.col("__cell")) & (F.col("part") == F.col("__part"))).select("cell", "part", F.col("__block").alias("block"), "vec_id", "vec")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return none
        q_ids = right["query_id"].to_numpy()
        tree = DualTree(np.array(right["vec"].tolist(), np.int64), q_ids, np.array(left["vec"].tolist(), np.int64), left["vec_id"].to_numpy(), k, right["floor"].to_numpy())
        tree.run()
        return pd.DataFrame({"query_id": np.repeat(q_ids, [len(f) for f in tree.found]), "vec_id": np.concatenate(tree.found), "score": np.concatenate(tree.scores)})

    found = dealt.groupBy(*key).cogroup(aimed.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")
    return best(found, k, descending=True)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 1024,
    k: int = 10,
    cells: int = 16,
    sample_rows: int = 2048,
    part_rows: int = 4096,
    block_queries: int = 2048,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k highest inner products, but its own id."""

    def narrow(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(usable(F.col(vec_col), zero=True) & F.col(id_col).isNotNull())
        return rows.select(F.col(id_col).cast("long").alias(name), scaled(F.col(vec_col), scale).alias("vec"), F.size(vec_col).alias("dim"))

    base, asked = materialize(narrow(vectors, "vec_id")), narrow(queries, "query_id").dropDuplicates(["query_id"])
    dims = [r.dim for r in base.groupBy("dim").count().orderBy("dim").limit(65).collect()]
    if len(dims) > 64:
        raise ValueError("vectors of more than 64 lengths")
    if not dims:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = None
    for dim in dims:
        one = _search_dim(base.filter(F.col("dim") == dim).drop("dim"), asked.filter(F.col("dim") == dim).drop("dim"), dim, k, cells, sample_rows, part_rows, block_queries)
        out = one if out is None else out.unionByName(one)
    return out


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e q, e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
