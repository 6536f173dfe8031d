"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length one, is turned by a pseudo-rotation (three rounds of
random signs and a fast Hadamard transform) and falls to the nearest signed
axis.  Each table has its own rotation.  A query also probes the next-nearest
axes of every table; what it meets there is ranked again by Euclidean distance
in double precision on the original vectors.

Every row is indexed in every table.  Rows meet queries in groups of (vector
length, table, axis); a group of more than ``part_rows`` rows, such as many
copies of one vector, is split over several tasks by a hash of the id, and the
queries that probe it go to each part.  A query that has found fewer than ``k``
rows is compared with all rows, through all axes of one table.

Defined results: null, empty, zero and non-finite vectors, and rows without an
id, take no part; only vectors of equal length are compared; rows with one id
count as one candidate, at its smallest distance; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.vectors import best, usable
from sedimenta.plans.scratch import materialize

_KEY = ["dim", "tab", "axis", "part"]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Signs of the rounds of every table: (tables, 3, width)."""
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, 3, width))


def axes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest signed axes in each table: (rows, tables, probes).

    Axis ``2 i`` is the positive and ``2 i + 1`` the negative direction of
    coordinate ``i``.
    """
    n, dim = vectors.shape
    signs = rotations(dim, tables, seed)
    width = signs.shape[2]
    unit = np.zeros((n, width))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, :dim] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    out = np.empty((n, tables, probes), np.int32)
    for t in range(tables):
        turned = unit
        for r in range(3):
            turned = hadamard(turned * signs[t, r])
        nearness = np.empty((n, 2 * width))
        nearness[:, 0::2], nearness[:, 1::2] = turned, -turned
        out[:, t] = np.argsort(-nearness, axis=1, kind="stable")[:, :probes]
    return out


def _axes_column(vec: Column, tables: int, probes: int, seed: int) -> Column:
    """Array of ``tables * probes`` (table, axis) pairs, as table * 2^20 + axis."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[np.ndarray | None] = [None] * len(batch)
            lengths = batch.map(len).to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                width = 1 << max(0, int(dim) - 1).bit_length()
                found = axes(np.array([batch.iloc[i] for i in at], np.float64), tables, min(probes, 2 * width), seed)
                coded = (found + (np.arange(tables, dtype=np.int32) << 20)[None, :, None]).reshape(len(at), -1)
                for i, row in zip(at, coded, strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return run(vec)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact ``(query position, id, distance)`` of each query's k nearest rows but its own id."""
    at, found, score = [], [], []
    square = (rows * rows).sum(axis=1)
    repeated = len(np.unique(ids)) < len(ids)
    for i, (q, own) in enumerate(zip(queries, query_ids, strict=True)):
        keep = ids != own
        if not keep.any():
            continue
        rough = square + q @ q - 2 * (rows @ q)
        rough[~keep] = np.inf
        kth = np.partition(rough, min(k, keep.sum()) - 1)[min(k, keep.sum()) - 1]
        near = np.flatnonzero(keep if repeated else keep & (rough <= kth + 1e-9 * (1 + abs(kth) + q @ q)))
        exact = np.sqrt(((rows[near] - q) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact))
        if repeated:
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
        order = order[:k]
        at.append(np.full(len(order), i))
        found.append(ids[near][order])
        score.append(exact[order])
    if not at:
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(at), np.concatenate(found), np.concatenate(score)


def _meet(index: DataFrame, probes: DataFrame, k: int, part_rows: int) -> DataFrame:
    """``query_id, vec_id, score`` from each (group, part) where rows and probing queries meet."""
    group = ["dim", "tab", "axis"]
    sizes = materialize(index.groupBy(*group).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
    rows = index.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = probes.join(sizes, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        v, q = np.array(left["vec"].tolist(), np.float64), np.array(right["vec"].tolist(), np.float64)
        at, ids, score = nearest(q, right["query_id"].to_numpy(), v, left["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[at], "vec_id": ids, "score": score})

    left = rows.select(*_KEY, "vec_id", "vec").groupBy(*_KEY)
    right = asked.select(*_KEY, "query_id", "vec").groupBy(*_KEY)
    return left.cogroup(right).applyInPandas(run, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    tables: int = 12,
    probes: int = 8,
    part_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k nearest rows found, but its own id."""

    def narrow(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(usable(F.col(vec_col), zero=False) & F.col(id_col).isNotNull())
        return rows.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"))

    def coded(df: DataFrame, p: int, t: int = tables) -> DataFrame:
        pairs = df.withColumn("pair", F.explode(_axes_column(F.col("vec"), t, p, seed)))
        return pairs.withColumns({"tab": F.shiftright("pair", 20), "axis": F.col("pair").bitwiseAND((1 << 20) - 1)}).drop("pair")

    base, asked = narrow(vectors, "vec_id"), narrow(queries, "query_id")
    first = materialize(best(_meet(coded(base, 1), coded(asked, probes), k, part_rows), k, descending=False))
    done = first.filter(F.col("rank") == k).select("query_id")
    short = materialize(asked.join(done, "query_id", "left_anti"))
    if short.isEmpty():
        return first
    every = best(_meet(coded(base, 1, 1), coded(short, 1 << 20, 1), k, part_rows), k, descending=False)
    return first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(every)
