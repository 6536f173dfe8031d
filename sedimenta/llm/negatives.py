"""Hard negatives of anchors: exact integer products of tiles by Strassen's recursion, kept in mergeable heaps.

Each component becomes ``floor(scale * x)``; the score of two rows is their integer
inner product.  First every anchor meets the rows of its own label, in parts of
bounded size, and keeps its best ``positives``; small labels share a task.  Then
blocks of anchors meet parts of all rows: for each positive, of score ``p``, the best
``negatives`` rows of other labels with ``low * p <= 100 * score <= high * p`` are kept.
In a task, tiles of both sides, padded with zeros to even sides, are multiplied with
seven products of half the side at each step of the recursion.  What a tile yields
goes into heaps of a fixed size, one an anchor or an anchor and positive; heaps of
tiles and of tasks merge to the heap of all rows, in any order.

Defined results: rows with a null id or label, a null or empty vector, or a null or
non-finite component take no part (zero vectors do); of rows with one id the one
with the smallest label, then vector, counts; only vectors of equal length are
compared; scores beyond 64 bits count as the nearest number of 64 bits; fewer
rows than asked for are all returned; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.topk import scaled
from sedimenta.llm.vectors import usable
from sedimenta.plans.scratch import materialize

#: Sides of tiles in a task, and the side at which the recursion ends.
TILE, LEAF = 1024, 32
MOST = (1 << 63) - 1
#: The score of an empty place in a heap; real ones are above.
EMPTY = -MOST - 1


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product: in double precision where no partial sum can pass 2^53, else in 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of half the side, exact modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:m, :n], out[m:, n:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:m, n:] = p
    out[m:, n:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:m, :n] += p
    out[m:, :n] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:m, :n] += strassen(a12 - a22, b21 + b22, leaf)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``a`` and ``b``, clipped to 64 bits."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] <= MOST:
        return strassen(a, b.T)
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST, MOST).astype(np.int64)


class Heaps:
    """The ``k`` best ``(score, id)`` of each of ``n`` owners, higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), EMPTY), np.full((n, k), MOST)

    def push(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in loose entries."""
        touched = np.unique(owners)
        own = np.concatenate((np.repeat(touched, self.k), owners))
        s, i = np.concatenate((self.scores[touched].ravel(), scores)), np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((i, ~s, own))  # ~ turns the order round without overflow
        own, s, i = own[order], s[order], i[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        keep = place < self.k
        self.scores[own[keep], place[keep]], self.ids[own[keep], place[keep]] = s[keep], i[keep]

    def push_tile(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take in a tile whose rows belong to the owners from ``first`` and whose columns are ordered by id."""
        s = np.where(allowed & (scores >= self.scores[first : first + len(scores), -1:]), scores, EMPTY)
        if s.shape[1] > self.k:
            worst = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
            tie = s == worst
            s = np.where((s > worst) | (tie & (np.cumsum(tie, axis=1) <= self.k)), s, EMPTY)
        rows, columns = np.nonzero(s != EMPTY)
        if len(rows):
            self.push(rows + first, s[rows, columns], ids[columns])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, scores and ids of all that is kept."""
        owners, places = np.nonzero(self.scores != EMPTY)
        return owners, self.scores[owners, places], self.ids[owners, places]


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(-1, dim)


def _tiles(n: int, m: int):
    return ((slice(i, min(i + TILE, n)), slice(j, min(j + TILE, m))) for j in range(0, m, TILE) for i in range(0, n, TILE))


def _best(found: DataFrame, owner: list[str], score: str, key: str, k: int) -> DataFrame:
    """Merges the heaps of all tasks; Spark cuts each task's share to ``k`` before the shuffle too."""
    run = W.partitionBy(*owner).orderBy(F.col(score).desc(), F.col(key).asc())
    return found.withColumn("rank", F.row_number().over(run)).filter(F.col("rank") <= k)


def _positives(rows: DataFrame, k: int, part_rows: int, block_rows: int, total: int) -> DataFrame:
    kinds = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / part_rows).alias("parts"), F.ceil(F.count_if("anchor") / block_rows).alias("blocks"))
    dealt = rows.join(kinds.filter("blocks > 0"), ["label", "dim"]).withColumn("bucket", F.pmod(F.xxhash64("label", "dim"), F.lit(max(1, -(-total // part_rows)))))
    part, block = (F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int") for salt, n in ((1, F.col("parts")), (2, F.col("blocks"))))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    group, carried = ["bucket", "part", "block"], ["label", "dim", "id", "vec"]
    right = dealt.withColumn("part", part).withColumn("block", every("blocks")).select(*group, *carried)
    left = dealt.filter("anchor").withColumn("block", block).withColumn("part", every("parts")).select(*(F.col(c).alias(c) for c in group + carried))

    def run(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = []
        of = {kind: frame.sort_values("id") for kind, frame in others.groupby(["label", "dim"])} if len(anchors) else {}
        for kind, own in anchors.groupby(["label", "dim"]):
            if kind not in of:
                continue
            ids, a = own["id"].to_numpy(), _matrix(own["vec"], kind[1])
            other_ids, b = of[kind]["id"].to_numpy(), _matrix(of[kind]["vec"], kind[1])
            heaps = Heaps(len(ids), k)
            for i, j in _tiles(len(ids), len(other_ids)):
                heaps.push_tile(i.start, products(a[i], b[j]), other_ids[j], ids[i, None] != other_ids[None, j])
            owners, scores, best = heaps.entries()
            found.append(pd.DataFrame({"anchor_id": ids[owners], "positive_id": best, "positive_score": scores}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "positive_id", "positive_score")})

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, "anchor_id long, positive_id long, positive_score long")
    return _best(found, ["anchor_id"], "positive_score", "positive_id", k).drop("rank")


def mine(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    part_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows where ``anchors`` holds.

    Labels are integers.  Work is anchors times rows; a task holds ``block_rows``
    anchors and ``part_rows`` rows, whatever the sizes of labels.
    """
    vec = F.col(f"`{vec_col}`")
    taken = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.struct(F.col(f"`{label_col}`").cast("long").alias("label"), scaled(vec, scale).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor")).alias("row"),
        usable(vec, zero=True).alias("ok"),
    ).filter("ok and id is not null and row.label is not null")
    rows = materialize(taken.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec", "row.anchor", F.size("row.vec").alias("dim")))
    total, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    chunks, blocks = max(1, -(-total // part_rows)), max(1, -(-asked // block_rows))

    near = _positives(rows, positives, part_rows, block_rows, total)
    lists = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("near"))
    aims = materialize(rows.filter("anchor").join(lists, F.col("id") == F.col("anchor_id")).select("id", "label", "vec", "dim", "near.positive_id", "near.positive_score"))
    chunk, block = (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int") for salt, n in ((1, chunks), (2, blocks)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    right = rows.select(chunk.alias("chunk"), every(blocks).alias("block"), "label", "dim", "id", "vec")
    left = aims.select(every(chunks).alias("chunk"), block.alias("block"), "label", "dim", "id", "vec", "positive_id", "positive_score")
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = []
        of = {dim: frame.sort_values("id") for dim, frame in others.groupby("dim")} if len(own) else {}
        for dim, mine in own.groupby("dim"):
            if dim not in of:
                continue
            ids, labels, a = mine["id"].to_numpy(), mine["label"].to_numpy(), _matrix(mine["vec"], dim)
            other_ids, other_labels, b = of[dim]["id"].to_numpy(), of[dim]["label"].to_numpy(), _matrix(of[dim]["vec"], dim)
            # a heap for each anchor and place of a positive; where there are fewer, the window is empty
            near, score = np.full((len(ids), positives), MOST), np.zeros((len(ids), positives), np.int64)
            least, most = np.full((len(ids), positives), MOST), np.full((len(ids), positives), EMPTY)
            for r, (p_ids, p_scores) in enumerate(zip(mine["positive_id"], mine["positive_score"], strict=True)):
                near[r, : len(p_ids)], score[r, : len(p_ids)] = p_ids, p_scores
                for c, p in enumerate(map(int, p_scores)):  # 64-bit products could overflow
                    least[r, c], most[r, c] = np.clip(-(-low * p // 100), EMPTY, MOST), np.clip(high * p // 100, EMPTY, MOST)
            windows = [Heaps(len(ids), negatives) for _ in range(positives)]
            for i, j in _tiles(len(ids), len(other_ids)):
                scores, differ = products(a[i], b[j]), labels[i, None] != other_labels[None, j]
                for c, heaps in enumerate(windows):
                    heaps.push_tile(i.start, scores, other_ids[j], differ & (scores >= least[i, c, None]) & (scores <= most[i, c, None]))
            for c, heaps in enumerate(windows):
                owners, s, best = heaps.entries()
                found.append(pd.DataFrame(dict(zip(names, (ids[owners], near[owners, c], score[owners, c], best, s), strict=True))))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})

    key = ["chunk", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, ", ".join(f"{c} long" for c in names))
    return _best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
