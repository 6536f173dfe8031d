"""Many weighted logistic fits at once, and the share of a mixture refitted on every resample.

Rows are packed into blocks of a few thousand with the multiplicities of their units
(whole groups of rows, say repositories) in every model.  A Newton step of all models is one
pass over the blocks: gradients and Hessians of all models are matrix products of a block.
What reaches the driver is one vector and one packed matrix a model, bounded by the numbers
of models and features; rows of a very large unit spread over many blocks.

Where models are many, a unit's rows meet only the models that hold the unit, and all models start
from the fit of their sum, where a row has one probability for all of them.  Around it a model's sums are
power series of its coefficients, whose terms are sums of units; a model that the series tells closely enough
meets no row of its own.  In the same way a row is scored by every model only where its place among the
quantiles depends on the model: bounds over all models tell the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations_with_replacement
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.quantify import same_keys
from sedimenta.plans.scratch import discard, materialize

#: Rows of a block, rows multiplied at once, and models whose sums travel together.
BLOCK_ROWS, CHUNK_ROWS, CHUNK_MODELS = 4096, 1024, 64
#: Least reference variation, cells of a first histogram, rows looked at one by one near a quantile.
LEAST_VARIATION, CELLS, GATHERED = 0.05, 4096, 512
#: From so many models on, units of a block are looked at one by one; most blocks that a task makes, about.
MANY_MODELS, TASK_BLOCKS = 64, 64
#: Most sums a model of the power series, most gaps between edges, cells of a first look at all scores, halvings of the way to a quantile.
SERIES_SUMS, GAPS, FIRST_CELLS, HALVINGS = 256, 256, 1 << 16, 11
#: Rows of room around guessed quantiles, and of the cells there.
GUESS_ROWS, GUESS_CELL = 2048, 96
#: Error of standardized coefficients below which the power series will do; at most |s'|, |s''|, ... of the logistic function s.
CLOSE, SLOPES = 1e-10, (0.25, 0.0963, 0.126, 0.131, 0.251, 0.409)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Blocks are large; few go to a Python worker at once, while this lasts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Block:
    """Rows of a block: features, label, weight, and the multiplicities of each row's unit in every model."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    unit: np.ndarray
    copies: np.ndarray

    @classmethod
    def unpack(cls, row, features: int) -> Block:
        units = np.frombuffer(row.copies, np.uint16).reshape(row.units, -1)
        return cls(np.frombuffer(row.x).reshape(-1, features), np.frombuffer(row.y, np.int8), np.frombuffer(row.w), np.frombuffer(row.unit, np.int32), units)

    def rows(self, keep: np.ndarray) -> Block:
        return Block(self.x[keep], self.y[keep], self.w[keep], self.unit[keep], self.copies)

    def chunks(self) -> Iterator[Block]:
        for i in range(0, len(self.y), CHUNK_ROWS):
            at = slice(i, i + CHUNK_ROWS)
            yield Block(self.x[at], self.y[at], self.w[at], self.unit[at], self.copies)

    def runs(self) -> Iterator[tuple[int, slice]]:
        """Each unit with the rows it has here; rows stand in order of units."""
        starts = np.flatnonzero(np.diff(self.unit, prepend=-1))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(self.unit)], strict=True):
            yield int(self.unit[a]), slice(a, z)


def packed(df: DataFrame, multiplicities: DataFrame, *, unit: list[str], features: list[str], label: Column, weight: Column, models: int, seed: int = 5, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of the rows that take part in any model.

    ``multiplicities`` has ``model`` (from 0) and ``copies`` by ``unit``; units that it lacks take no part.
    ``made`` turns the dense multiplicities (a row a unit) into those of the models that are fitted.
    Null features count as 0, rows without label or positive weight are left out.
    """
    vectors = multiplicities.groupBy(*unit).agg(F.collect_list(F.struct("model", "copies")).alias("__copies"))  # models entries at most
    numbers = [f"__x{i}" for i in range(len(features))]
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, numbers, strict=True)]
    rows = df.select(*unit, *value, label.cast("tinyint").alias("__y"), weight.cast("double").alias("__w")).filter("__y is not null and __w > 0")
    sizes = materialize(rows.groupBy(*unit).agg(F.count("*").alias("__n"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__salts")).withColumn("__key", F.monotonically_increasing_id()))
    kind = pa.schema([("n", pa.int32()), ("units", pa.int32()), *[(c, pa.binary()) for c in ("x", "y", "w", "unit", "copies")]])
    buckets = max(1, -(-(sizes.agg(F.sum("__n")).first()[0] or 0) // BLOCK_ROWS))

    def dealt(frame: DataFrame, salt: Column) -> DataFrame:
        salted = same_keys(frame, sizes.select(*unit, "__salts", "__key"), unit).withColumn("__salt", salt)
        return salted.withColumn("__bucket", F.pmod(F.xxhash64("__key", "__salt"), F.lit(buckets)))

    left = dealt(rows, F.floor(F.rand(seed) * F.col("__salts")).cast("int")).select("__bucket", "__key", *numbers, "__y", "__w")
    right = dealt(vectors, F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).select(F.col("__bucket").alias("__held"), F.col("__key").alias("__of"), F.col("__copies.model").alias("__models"), F.col("__copies.copies").alias("__times"))

    def pack(data: pa.Table, held: pa.Table) -> pa.Table:
        if not len(held):
            return kind.empty_table()
        keys, first = np.unique(held["__of"].to_numpy(), return_index=True)  # several salts of a unit may meet here
        copies = np.zeros((len(keys), models), np.uint16)
        for i, k in enumerate(first.tolist()):
            copies[i, held["__models"][k].values.to_numpy()] = held["__times"][k].values.to_numpy()
        if made is not None:
            copies = made(copies)
        key = data["__key"].to_numpy()
        at = np.searchsorted(keys, key)
        known = np.flatnonzero(np.append(keys, -1)[at] == key)
        if not len(known):
            return kind.empty_table()
        inorder = known[np.argsort(at[known], kind="stable")]
        used, where = np.unique(at[inorder], return_inverse=True)
        x, y, w = (np.column_stack([data[c].to_numpy()[inorder] for c in names]) for names in (numbers, ["__y"], ["__w"]))
        one = {
            "n": len(inorder), "units": len(used), "x": x.astype(np.float64).tobytes(), "y": y.astype(np.int8).tobytes(), "w": w.astype(np.float64).tobytes(),
            "unit": where.astype(np.int32).tobytes(), "copies": copies[used].tobytes(),
        }
        return pa.table({k: [v] for k, v in one.items()}, kind)

    # tasks grow with the rows, so that none sorts more than so many blocks
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BLOCKS))
    left, right = left.repartition(tasks, "__bucket"), right.repartition(tasks, "__held")
    blocks = left.groupBy("__bucket").cogroup(right.groupBy("__held")).applyInArrow(pack, "n int, units int, x binary, y binary, w binary, unit binary, copies binary")
    return materialize(blocks)


def streamed(df: DataFrame, number: Column, copies: np.ndarray, *, features: list[str], label: Column, weight: Column) -> DataFrame:
    """Blocks of rows as they stand in their tasks, without a shuffle, where units are few.

    ``number`` is the row's unit, whose multiplicities are that row of ``copies`` (a column a model).  Nulls
    and weights are treated as by :func:`packed`; rows without a unit are left out.
    """
    numbers = [f"__x{i}" for i in range(len(features))]
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, numbers, strict=True)]
    rows = df.select(number.cast("int").alias("__unit"), *value, label.cast("tinyint").alias("__y"), weight.cast("double").alias("__w")).filter("__unit is not null and __y is not null and __w > 0")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            unit = frame["__unit"].to_numpy()
            inorder = np.argsort(unit, kind="stable")
            used, where = np.unique(unit[inorder], return_inverse=True)
            x, y, w = (frame[c].to_numpy()[inorder] for c in (numbers, "__y", "__w"))
            one = {
                "n": len(unit), "units": len(used), "x": np.ascontiguousarray(x, np.float64).tobytes(), "y": y.astype(np.int8).tobytes(), "w": w.astype(np.float64).tobytes(),
                "unit": where.astype(np.int32).tobytes(), "copies": copies[used].astype(np.uint16).tobytes(),
            }
            yield pd.DataFrame({k: [v] for k, v in one.items()})

    with few_rows(df.sparkSession, BLOCK_ROWS):
        return materialize(rows.mapInPandas(pack, "n int, units int, x binary, y binary, w binary, unit binary, copies binary"))


def summed(blocks: DataFrame, features: int, models: int, sums: Callable[..., np.ndarray | None], kind: type[Block] = Block, whole: bool = False, width: int = 0) -> np.ndarray:
    """What ``sums`` gives for each block (a row a model), added up over all blocks; a ``whole`` block is not cut into chunks.

    With a ``width`` (numbers a model), ``sums`` adds to its second argument instead.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for row in frame.itertuples():
                block = kind.unpack(row, features)
                for part in [block] if whole else block.chunks():
                    if width:
                        total = np.zeros((models, width)) if total is None else total
                        sums(part, total)
                        continue
                    own = sums(part)
                    if total is None:
                        total = own
                    else:
                        total += own
        if total is not None:
            parts = [np.ascontiguousarray(total[i : i + CHUNK_MODELS]).tobytes() for i in range(0, models, CHUNK_MODELS)]
            yield pd.DataFrame({"chunk": range(len(parts)), "sums": parts})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "sums": [np.sum([np.frombuffer(s) for s in rows["sums"]], axis=0).tobytes()]})

    schema = "chunk int, sums binary"
    with few_rows(blocks.sparkSession, 4):
        found = blocks.mapInPandas(partial, schema).groupBy("chunk").applyInPandas(add, schema).collect()  # a row for 64 models
    out = [np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.chunk)]
    return np.concatenate(out).reshape(models, -1) if out else np.zeros((models, 0))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    """Of a new array, which it overwrites."""
    np.clip(t, -35, 35, out=t)
    np.exp(np.negative(t, out=t), out=t)
    t += 1.0
    return np.divide(1.0, t, out=t)


@dataclass
class Fits:
    """Models over raw features: the intercept, then a coefficient a feature; ``failed`` where a class is missing or the system has no solution."""

    features: list[str]
    beta: np.ndarray
    failed: np.ndarray

    def scores(self, x: np.ndarray, models: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Rounded, so that a row has one score in every pass, whatever rows it is multiplied with; edges fall on scores."""
        b = self.beta[models]
        t = x @ b[:, 1:].T
        t += b[:, 0]
        t = _sigmoid(t)
        return np.round(t, 12, out=t)

    def score(self, model: int) -> Column:
        z = F.lit(float(self.beta[model, 0]))
        for f, b in zip(self.features, self.beta[model, 1:], strict=True):
            z = z + F.lit(float(b)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def fit_many(blocks: DataFrame, *, features: list[str], models: int, ridge: float = 1.0, balanced: bool = False, rounds: int = 40, tolerance: float = 1e-7) -> Fits:
    """Ridge logistic fits of all models together.

    In each model features are standardized by its own rows, weights scaled to mean 1
    (after weighing both classes alike if ``balanced``), and the intercept is not
    penalized.  Models that have converged leave the pass.  From ``MANY_MODELS`` on they start where
    the fit of their sum ends, and go as far as power series around it tell (see :class:`_Series`), within ``CLOSE``.
    """
    p = len(features)
    many = models >= MANY_MODELS
    # numerically, everything is taken around the means of all rows; each model's own scaling is a transformation of that
    whole = summed(blocks, p, 1, lambda b: np.concatenate(([len(b.y)], b.x.sum(0), (b.x**2).sum(0), [(b.y == 1).sum()], b.x[b.y == 1].sum(0), (b.x.T @ b.x).ravel()))[None])
    if not whole.size:
        return Fits(features, np.zeros((models, p + 1)), np.ones(models, bool))
    mid = whole[0, 1 : p + 1] / whole[0, 0]
    spread = np.sqrt(np.maximum(whole[0, p + 1 : 2 * p + 1] / whole[0, 0] - mid**2, 0))
    spread = np.where(spread < 1e-9, 1.0, spread)

    def by_unit(b: Block, columns: np.ndarray) -> np.ndarray:
        """Sums of ``columns`` in every model, by way of the sums of each unit."""
        held = np.flatnonzero(np.diff(b.unit, prepend=-1))
        return b.copies[b.unit[held]].astype(np.float64).T @ np.add.reduceat(columns, held, axis=0)

    def first(b: Block) -> np.ndarray:
        x = (b.x - mid) / spread
        return by_unit(b, np.column_stack((np.ones(len(b.y)), b.w * (b.y == 1), b.w * (b.y == 0), b.y == 1, x, x**2)))

    s = summed(blocks, p, models, first)
    n, w1, w0, n1 = s[:, 0], s[:, 1], s[:, 2], s[:, 3]
    failed = (n1 <= 0) | (n1 >= n)
    n = np.maximum(n, 1)
    own_mid = s[:, 4 : 4 + p] / n[:, None]
    own_spread = np.sqrt(np.maximum(s[:, 4 + p :] / n[:, None] - own_mid**2, 0))
    own_spread = np.where(own_spread * spread < 1e-9, 1 / spread, own_spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.stack((n / (2 * (n - n1)), n / (2 * n1)), axis=1) if balanced else np.ones((models, 2))
        factor = np.where(failed[:, None], 1.0, factor / ((factor[:, 0] * w0 + factor[:, 1] * w1) / n)[:, None])
    turn = np.zeros((models, p + 1, p + 1))
    turn[:, 0, 0] = 1
    turn[:, range(1, p + 1), 0] = -own_mid / own_spread
    turn[:, range(1, p + 1), range(1, p + 1)] = 1 / own_spread
    penalty = np.diag([0.0] + [ridge] * p)
    upper = np.triu_indices(p + 1)
    beta = np.zeros((models, p + 1))  # of each model's own scaling
    active = np.flatnonzero(~failed)
    common = None
    if many and len(active):
        for start in (_normal_start(whole[0], mid, spread), np.zeros(p + 1)):
            common = _common(blocks, p, mid, spread, s[~failed].sum(axis=0), start, ridge, rounds, tolerance) if common is None and start is not None else common
    if common is not None:
        beta[active] = np.linalg.solve(turn[active].transpose(0, 2, 1), np.tile(common[:, None], (len(active), 1, 1)))[:, :, 0]

    series = _Series(p + 1)

    def together(b: Block, out: np.ndarray) -> None:
        # all models stand at one point: a row has one probability, and a unit's sums serve all models
        x = np.vstack((np.ones(len(b.y)), ((b.x - mid) / spread).T))
        columns, starts = series.columns(x, b.y, b.w, common), np.flatnonzero(np.diff(b.unit, prepend=-1))
        copies = b.copies[b.unit[starts]].astype(np.float64).T
        for c in (0, 1) if balanced else (None,):
            own = columns if c is None else columns * (b.y == c)
            out += factor[:, c or 0, None] * (copies @ np.add.reduceat(own, starts, axis=1).T)

    for turn_no in range(rounds):
        if not len(active):
            break
        inner = np.einsum("kij,ki->kj", turn[active], beta[active])

        def step(b: Block, active=active, inner=inner) -> np.ndarray:
            x = np.column_stack((np.ones(len(b.y)), (b.x - mid) / spread))
            pairs = x[:, upper[0]] * x[:, upper[1]]
            if many:
                out = np.zeros((len(active), x.shape[1] + pairs.shape[1]))
                copies = b.copies[:, active]
                for unit, at in b.runs():
                    k = np.flatnonzero(copies[unit])  # models that lack the unit have nothing to add
                    if not len(k):
                        continue
                    y, m = b.y[at, None], copies[unit, k, None].astype(np.float64)
                    w = b.w[at, None] * np.where(y == 1, factor[active[k], 1], factor[active[k], 0])
                    prob = _sigmoid(x[at] @ inner[k].T)
                    rest = y - prob
                    rest *= w
                    out[k, : p + 1] += m * (rest.T @ x[at])
                    w *= prob
                    w *= np.subtract(1, prob, out=prob)
                    out[k, p + 1 :] += m * (np.maximum(w, 1e-8, out=w).T @ pairs[at])
                return out
            m = b.copies[:, active][b.unit].astype(np.float64)
            w = b.w[:, None] * np.where(b.y[:, None] == 1, factor[active, 1], factor[active, 0])
            prob = _sigmoid(x @ inner.T)
            return np.concatenate(((m * w * (b.y[:, None] - prob)).T @ x, (m * np.maximum(w * prob * (1 - prob), 1e-8)).T @ pairs), axis=1)

        if common is not None and not turn_no:
            sums = summed(blocks, p, models, together, whole=True, width=series.width)[active]
            beta[active], near = series.solved(sums, turn[active], beta[active], penalty)
            active = active[~near]
            continue
        sums = summed(blocks, p, len(active), step)
        h = np.zeros((len(active), p + 1, p + 1))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = sums[:, p + 1 :]
        t = turn[active]
        g = np.einsum("kij,kj->ki", t, sums[:, : p + 1]) - beta[active] @ penalty
        h = t @ h @ t.transpose(0, 2, 1) + penalty
        moved = _solved_each(h, g)
        bad = ~np.isfinite(moved).all(axis=1)
        failed[active[bad]] = True
        beta[active[~bad]] += moved[~bad]
        still = np.abs(np.nan_to_num(moved)).max(axis=1) >= tolerance
        active = active[~bad & still]
    inner = np.einsum("kij,ki->kj", turn, beta)
    raw = inner / np.concatenate(([1.0], spread))
    raw[:, 0] -= (inner[:, 1:] * mid / spread).sum(axis=1)
    return Fits(features, raw, failed)


class _Series:
    """Gradients and Hessians of weighted logistic fits as power series around one point, from sums over rows that do not depend on the fit.

    ``q`` features, the first of which is 1.  Term ``k`` is the symmetric tensor of the sums of products of ``k``
    features; the last sums bound what the series leaves out.
    """

    def __init__(self, q: int):
        self.q, self.terms, width = q, [[(i,) for i in range(q)]], q
        while len(self.terms) < len(SLOPES):
            more = list(combinations_with_replacement(range(q), len(self.terms) + 1))
            if len(self.terms) > 1 and width + len(more) + q > SERIES_SUMS:
                break
            self.terms.append(more)
            width += len(more)
        self.order, self.width = len(self.terms), width + q
        # where each entry of a whole tensor stands among the sums of its term
        self.entries = []
        for k, terms in enumerate(self.terms, start=1):
            place = {t: i for i, t in enumerate(terms)}
            self.entries.append([place[tuple(sorted(t))] for t in np.ndindex(*(q,) * k)])

    def columns(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The row's part of every sum; ``x`` has a row a feature."""
        prob = _sigmoid(point @ x)
        first = prob * (1 - prob)
        second = first * (1 - 2 * prob)
        slopes = [first, second, first * (1 - 6 * first), second * (1 - 12 * first), first * (1 - 30 * first + 120 * first**2)]
        out, product, at = np.empty((self.width, len(y))), x, self.q
        np.multiply(x, w * (y - prob), out=out[:at])
        for terms, before, slope in zip(self.terms[1:], self.terms, slopes, strict=False):
            place = {t: i for i, t in enumerate(before)}
            product = product[[place[t[:-1]] for t in terms]] * x[[t[-1] for t in terms]]
            np.multiply(product, w * slope, out=out[at : at + len(terms)])
            at += len(terms)
        np.multiply(np.abs(x) ** (self.order + 1), w, out=out[at:])
        return out

    def at(self, sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and Hessians of models that stand ``d`` from the point."""
        n, q = d.shape
        gradient, hessian, start = sums[:, :q].copy(), np.zeros((n, q, q)), q
        for k, (terms, entries) in enumerate(zip(self.terms[1:], self.entries[1:], strict=True), start=1):
            part, start = sums[:, start : start + len(terms)][:, entries], start + len(terms)
            for _ in range(k - 1):
                part = np.einsum("mik,mk->mi", part.reshape(n, -1, q), d)
            part = part.reshape(n, q, q)
            hessian += part / factorial(k - 1)
            gradient -= np.einsum("mij,mj->mi", part, d) / factorial(k)
        return gradient, hessian

    def left_out(self, sums: np.ndarray, d: np.ndarray) -> np.ndarray:
        """At most what the gradient of each model lacks."""
        k, size, moments = self.order, np.abs(d), sums[:, -self.q :]
        # by convexity, then by the means of powers
        high = (size * moments).sum(axis=1, keepdims=True) * k + size.sum(axis=1, keepdims=True) * moments
        return SLOPES[k - 1] / factorial(k) * size.sum(axis=1, keepdims=True) ** (k - 1) * high / (k + 1)

    def solved(self, sums: np.ndarray, turn: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of models that start at the point, and which of them are told closely enough."""
        out, close = beta.copy(), np.zeros(len(beta), bool)
        for i in range(0, len(beta), CHUNK_MODELS):
            at = slice(i, i + CHUNK_MODELS)
            out[at], close[at] = self._solved(sums[at], turn[at], beta[at], penalty)
        return out, close

    def _solved(self, sums: np.ndarray, turn: np.ndarray, start: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        point, beta, first = np.einsum("kij,ki->kj", turn, start), start, start
        with np.errstate(all="ignore"):
            for n in range(20):
                d = np.einsum("kij,ki->kj", turn, beta) - point
                gradient, hessian = self.at(sums, d)
                h = turn @ hessian @ turn.transpose(0, 2, 1) + penalty
                moved = _solved_each(h, np.einsum("kij,kj->ki", turn, gradient) - beta @ penalty)
                beta = beta + moved
                if not n:
                    first = beta  # a plain Newton step
                if not (np.abs(moved).max(axis=1) > 1e-13).any():
                    break
            d = np.einsum("kij,ki->kj", turn, beta) - point
            lacks = np.einsum("kij,kj->ki", np.abs(turn), self.left_out(sums, d))
            inverse = np.abs(_solved_each(h, np.broadcast_to(np.eye(self.q), h.shape)))
            error = 2 * np.einsum("kij,kj->ki", inverse, lacks).max(axis=1) + np.abs(moved).max(axis=1)
        close = error <= CLOSE
        beta = np.where((error < 1e-3)[:, None], beta, first)
        return np.where(np.isfinite(beta).all(axis=1)[:, None], beta, start), close


def _solved_each(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of many small systems, NaN where there is none."""
    side = g[:, :, None] if g.ndim == 2 else g
    out = np.full(side.shape, np.nan)
    for k in range(len(h)):
        try:
            out[k] = np.linalg.solve(h[k], side[k])
        except np.linalg.LinAlgError:
            pass
    return out.reshape(g.shape)


def _normal_start(whole: np.ndarray, mid: np.ndarray, spread: np.ndarray) -> np.ndarray | None:
    """The coefficients there would be if both classes were normal with one covariance; None if they are not to be had."""
    p = len(mid)
    n, n1 = whole[0], whole[2 * p + 1]
    if not 0 < n1 < n:
        return None
    up = (whole[2 * p + 2 : 3 * p + 2] / n1 - mid) / spread
    down = -up * n1 / (n - n1)
    inside = (whole[3 * p + 2 :].reshape(p, p) / n - np.outer(mid, mid)) / np.outer(spread, spread) - (n1 * np.outer(up, up) + (n - n1) * np.outer(down, down)) / n
    try:
        b = np.linalg.solve(inside + 1e-6 * np.eye(p), up - down)
    except np.linalg.LinAlgError:
        return None
    out = np.concatenate(([np.log(n1 / (n - n1)) - b @ (up + down) / 2], b))
    return out if np.isfinite(out).all() and np.abs(out).max() < 10 else None


def _common(blocks: DataFrame, p: int, mid: np.ndarray, spread: np.ndarray, s: np.ndarray, start: np.ndarray, ridge: float, rounds: int, tolerance: float) -> np.ndarray | None:
    """The fit, over features scaled by ``mid`` and ``spread``, of all rows with the sum of their multiplicities; ``s`` are its first sums."""
    scale = s[0] / (s[1] + s[2]) / s[0]  # rows weigh 1 in all: the ridge is no more than a safeguard
    penalty, upper = np.diag([0.0] + [ridge * 1e-6] * p), np.triu_indices(p + 1)
    beta = start
    for _ in range(rounds):

        def step(b: Block, beta=beta) -> np.ndarray:
            x = np.column_stack((np.ones(len(b.y)), (b.x - mid) / spread))
            w, prob = b.w * b.copies.sum(axis=1, dtype=np.float64)[b.unit] * scale, _sigmoid(x @ beta)
            return np.concatenate(((w * (b.y - prob)) @ x, (w * prob * (1 - prob)) @ (x[:, upper[0]] * x[:, upper[1]])))[None]

        sums = summed(blocks, p, 1, step)[0]
        h = np.zeros((p + 1, p + 1))
        h[upper] = h[upper[::-1]] = sums[p + 1 :]
        try:
            moved = np.linalg.solve(h + penalty, sums[: p + 1] - penalty @ beta)
        except np.linalg.LinAlgError:
            return None
        beta = beta + moved
        if not np.isfinite(beta).all() or np.abs(beta).max() > 30:
            return None  # the classes stand apart: each model goes its own way
        if np.abs(moved).max() < max(tolerance, 1e-3):
            break  # the next step is smaller by far, and models stand further from here than that
    return beta


def likeliest_shares(agent: np.ndarray, human: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The share of ``agent`` in each row of target counts under which they are likeliest, by bisection of the slope.

    The likelihood is concave in the share, so its slope falls.
    """
    low, high = np.zeros(len(target)), np.ones(len(target))

    def slope(q: np.ndarray) -> np.ndarray:
        mixed = np.clip(q[:, None] * agent + (1 - q[:, None]) * human, 1e-15, None)
        return (target * (agent - human) / mixed).sum(axis=1)

    for _ in range(60):
        mid = (low + high) / 2
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    out = (low + high) / 2
    return np.where(slope(np.zeros(len(target))) <= 0, 0.0, np.where(slope(np.ones(len(target))) >= 0, 1.0, out))


def own_scores(df: DataFrame, fits: Fits, models: DataFrame, *, on: str) -> DataFrame:
    """``df`` with ``score``, each row by the model that ``models`` (``on, model``) names for it; null where it has failed or there is none."""
    rows = [(k, [float(b) for b in fits.beta[k]]) for k in range(len(fits.beta)) if not fits.failed[k]]
    betas = df.sparkSession.createDataFrame(rows, "model int, __beta array<double>")  # a row a model
    # a row a model goes to every task: few values of ``on`` would else deal all rows to as few
    named = same_keys(df, F.broadcast(models.join(F.broadcast(betas), "model").select(on, "__beta")), [on], "left")
    z = F.col("__beta")[0]
    for i, f in enumerate(fits.features):
        z = z + F.col("__beta")[i + 1] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))  # greatest and least pass over nulls
    return named.withColumn("score", F.when(F.col("__beta").isNotNull(), score)).drop("__beta")


#: Scores of a block's rows: replicates (one, or one a score), the places of the rows in the block, scores, and the weights of all their copies.
Entries = Callable[[Block], Iterator[tuple[int | np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class _Cut:
    """The number of ``cuts`` (in order) at or below each score in [0, 1]; most scores fall in one of ``CELLS`` cells that no cut divides.

    Unless ``dense``: then most scores lie where the cuts do.
    """

    def __init__(self, cuts: np.ndarray, dense: bool = False):
        self.cuts, self.dense = cuts, dense
        if dense:
            return
        ends = np.arange(CELLS + 1) / CELLS
        self.base = np.searchsorted(cuts, ends[:-1], side="right").astype(np.int32)
        self.divided = np.searchsorted(cuts, ends[1:], side="left") > self.base
        self.divided[-1] = self.base[-1] < len(cuts)

    def places(self, score: np.ndarray) -> np.ndarray:
        if self.dense:
            return np.searchsorted(self.cuts, score, side="right")
        cell = np.minimum((score * CELLS).astype(np.int64), CELLS - 1)
        at = self.base[cell]
        inside = np.flatnonzero(self.divided[cell])
        at[inside] = np.searchsorted(self.cuts, score[inside], side="right")
        return at


def _placed(b: Block, entries: Entries, cut: list[_Cut], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(replicate * most + place, row, score, weight)`` of the entries of positive weight, replicate by replicate."""
    many = []
    for r, rows, score, weight in entries(b):
        if isinstance(r, np.ndarray):  # a column of scores each
            many.append((np.repeat(r.astype(np.int32), len(rows)), np.tile(rows, len(r)), score.T.ravel(), weight.T.ravel()))
        else:
            keep = weight > 0
            yield r * most + cut[r].places(score[keep]), rows[keep], score[keep], weight[keep]
    if many:
        which = np.concatenate([m[0] for m in many])
        inorder = np.argsort(which.astype(np.uint16) if len(cut) <= 1 << 16 else which, kind="stable")
        which, rows, score, weight = which[inorder], *(np.concatenate([m[i] for m in many])[inorder] for i in (1, 2, 3))
        at, starts = which.astype(np.int64) * most, np.flatnonzero(np.diff(which, prepend=-1))
        for i, z in zip(starts.tolist(), [*starts[1:].tolist(), len(which)], strict=True):
            at[i:z] += cut[which[i]].places(score[i:z])
        yield at, rows, score, weight


@dataclass
class _Bounds:
    """Between which scores a row stands under each of some fits, and how often each replicate holds the units of a block.

    The coefficients lie in an ellipsoid around ``mid``, whose half axes are ``axes``; ``own`` is the mean of each
    replicate's fits, less ``mid``.
    """

    mid: np.ndarray
    axes: np.ndarray
    own: np.ndarray
    held: Callable[[Block], np.ndarray]

    @classmethod
    def of(cls, beta: np.ndarray, ok: np.ndarray, held: Callable[[Block], np.ndarray]) -> _Bounds:
        """From the fits of every replicate (replicate, fit, coefficient); only those that are ``ok`` count."""
        mid = beta[ok].mean(axis=(0, 1))
        off = (beta[ok] - mid).reshape(-1, len(mid))
        size = np.sqrt((off**2).mean(axis=0))
        size[size == 0] = 1.0
        u, s, v = np.linalg.svd(off / size, full_matrices=False)
        return cls(mid, s[:, None] * v * size * np.sqrt((u**2).sum(axis=1).max()), beta.mean(axis=1) - mid, held)

    def linear(self, x: np.ndarray) -> np.ndarray:
        return x @ self.mid[1:] + self.mid[0]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest scores, with room for rounding."""
        t, off = self.linear(x), x @ self.axes[:, 1:].T + self.axes[:, 0]
        reach = np.sqrt(np.einsum("ij,ij->i", off, off)) * (1 + 1e-9) + 1e-9
        return _sigmoid(t - reach) - 2e-12, _sigmoid(t + reach) + 2e-12

    def weights(self, b: Block, at: np.ndarray, places: int) -> np.ndarray:
        """The weight of the rows at each of some places, for every replicate; a place below 0 is none."""
        inside = at >= 0
        sums = np.bincount(b.unit[inside] * places + at[inside], weights=b.w[inside], minlength=len(b.copies) * places)
        return self.held(b).T.astype(np.float64) @ sums.reshape(-1, places)


@dataclass
class _Gaps:
    """Ranges of scores, ``low <= score < high`` in order, inside which a row's place need not be known."""

    low: np.ndarray
    high: np.ndarray

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The gap that holds all scores from ``low`` to ``high``, -1 if none does."""
        at = np.searchsorted(self.low, low, side="right") - 1
        return np.where((at >= 0) & (high < self.high[at]), at, -1)


@dataclass
class _Guess:
    """Where the quantiles of each replicate seem to lie, as linear scores (replicate, quantile), how far these
    reach for a share of the weight, and the number of rows."""

    at: np.ndarray
    slope: np.ndarray
    rows: float

    def gaps(self, times: float) -> _Gaps | None:
        """Between the places of the quantiles; ``times`` widens the room around these."""
        low, high = self.at.min(axis=0), self.at.max(axis=0)
        room = times * (0.05 * (high - low) + self.slope * (GUESS_ROWS / self.rows))
        low, high = np.minimum.accumulate((low - room)[::-1])[::-1], np.maximum.accumulate(high + room)
        low, high = np.concatenate(([-1.0], _sigmoid(high))), np.concatenate((_sigmoid(low), [2.0]))
        kept = low < high
        return _Gaps(low[kept], high[kept]) if kept.any() else None

    def cuts(self, r: int, gaps: _Gaps) -> np.ndarray:
        """Cuts for a replicate that crowd around its quantiles; none is inside a gap."""
        off = np.concatenate((np.arange(1, 17), 16 * 2.0 ** np.arange(1, 20))) * GUESS_CELL / self.rows
        off = np.unique(np.concatenate((-off, [0.0], off)).clip(-1, 1))
        cuts = _sigmoid((self.at[r][:, None] + self.slope[:, None] * off).ravel())
        ends = np.concatenate((gaps.low, gaps.high))
        return np.unique(np.concatenate((cuts[gaps.of(cuts, cuts) < 0], ends[(ends > 0) & (ends < 1)])))


def guessed(blocks: DataFrame, bounds: _Bounds, *, features: int, replicates: int, bins: int) -> _Guess | None:
    """Quantiles under the fit in the middle by each replicate's weights, moved by what its own fits do to the rows there."""
    ends = np.linspace(-36, 36, FIRST_CELLS + 1)

    def first(b: Block, out: np.ndarray) -> None:
        at = ((np.clip(bounds.linear(b.x), -36, 36) + 36) * (FIRST_CELLS / 72)).astype(np.int64)
        at = np.minimum(at, FIRST_CELLS - 1)
        for i, weight in enumerate([np.ones(len(at)), b.w, *(b.x * b.w[:, None]).T]):
            out[i] += np.bincount(at, weights=weight, minlength=FIRST_CELLS)

    sums = summed(blocks, features, features + 2, first, whole=True, width=FIRST_CELLS)
    if not sums.size or not sums[1].any():
        return None
    upto = np.concatenate((np.zeros((features + 2, 1)), np.cumsum(sums, axis=1)), axis=1)
    total = upto[1, -1]
    inverse = lambda v: np.interp(v * total, upto[1], ends)
    wanted = np.linspace(0, 1, bins + 1)[1:-1]
    off = 0.5 / bins / 2.0 ** np.arange(0, HALVINGS, 0.25)
    cuts = np.unique(inverse(np.concatenate([wanted, *(wanted + o for o in off), *(wanted - o for o in off)])))
    cells = len(cuts) + 1

    def below(b: Block, out: np.ndarray) -> None:
        out += bounds.weights(b, np.searchsorted(cuts, bounds.linear(b.x), side="right"), cells)

    below_cuts = np.cumsum(summed(blocks, features, replicates, below, whole=True, width=cells), axis=1)
    low, high = inverse(wanted - 0.1 / bins), inverse(wanted + 0.1 / bins)
    around = np.array([np.interp(high, ends, u) - np.interp(low, ends, u) for u in upto[1:]])
    mean = np.vstack((np.ones(len(wanted)), around[1:] / np.maximum(around[0], 1e-300)))
    with_rows = np.flatnonzero(below_cuts[:, -1] > 0)
    at = np.full((replicates, len(wanted)), np.nan)
    for r in with_rows:
        at[r] = np.interp(wanted * below_cuts[r, -1], np.concatenate(([0.0], below_cuts[r])), np.concatenate(([-36.0], cuts, [36.0]))) + bounds.own[r] @ mean
    if not len(with_rows):
        return None
    at[np.isnan(at[:, 0])] = at[with_rows[0]]  # a replicate without rows has no quantiles
    return _Guess(at, (high - low) / (0.2 / bins), upto[0, -1])


def _add(out: np.ndarray, at: np.ndarray, weight: np.ndarray | float) -> None:
    """Adds weights to places of a flat view; few of them touch no more than their places."""
    if len(at) * 4 < len(out):
        np.add.at(out, at, weight)
    else:
        out += np.bincount(at, weights=weight if isinstance(weight, np.ndarray) else None, minlength=len(out))


def quantile_edges(blocks: DataFrame, entries: Entries, *, features: int, replicates: int, bins: int, bounds: _Bounds | None = None) -> list[np.ndarray]:
    """Distinct inner edges of ``bins`` of equal weight, for each replicate, of all its weighted scores in [0, 1].

    Quantiles lie between the midpoints of the weights in order.  A histogram finds the
    cells around each; cells with many rows are cut again, until the few rows near
    a quantile can be looked at one by one.  With ``bounds``, rows whose place cannot matter have no entries;
    their weights by gap are enough.
    """
    guess = guessed(blocks, bounds, features=features, replicates=replicates, bins=bins) if bounds is not None and bins > 1 else None
    for times in (1, 10) if guess is not None else ():
        gaps = guess.gaps(times)
        found = _edges(blocks, entries, features, replicates, bins, bounds, gaps, [guess.cuts(r, gaps) for r in range(replicates)]) if gaps is not None else None
        if found is not None:
            return found
    return _edges(blocks, entries, features, replicates, bins, None, None, [np.linspace(0, 1, CELLS + 1)[1:-1]] * replicates)


def _edges(blocks: DataFrame, entries: Entries, features: int, replicates: int, bins: int, bounds: _Bounds | None, gaps: _Gaps | None, cuts: list[np.ndarray]) -> list[np.ndarray] | None:
    """The edges, from ``cuts`` to start with; None where a quantile, or a row beside it, may be one of the rows left in a gap."""
    count = 0 if gaps is None else len(gaps.low)
    cut = [_Cut(c, bool(count)) for c in cuts] if count else [_Cut(cuts[0])] * replicates
    wanted = np.linspace(0, 1, bins + 1)[1:-1]

    def met(b: Block) -> tuple[Block, np.ndarray | None]:
        """The rows that are scored, and the gap of every row."""
        if gaps is None:
            return b, None
        gap = gaps.of(*bounds.scores(b.x))
        return b.rows(gap < 0), gap

    while True:
        most = max(len(c) for c in cuts) + 1

        width = 2 * most + count

        def histogram(b: Block, out: np.ndarray, cut=cut, most=most, width=width) -> None:
            near, gap = met(b)
            found = list(_placed(near, entries, cut, most))
            at, weight = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), np.concatenate([f[3] for f in found] or [np.empty(0)])
            at = at + at // most * (width - most)
            _add(out.reshape(-1), np.concatenate((at, at + most)), np.concatenate((weight, np.ones(len(at)))))
            if gap is not None:
                out[:, 2 * most :] += bounds.weights(b, gap, count)

        # a replicate's weights, its numbers of rows, and the weights left in gaps
        sums = summed(blocks, features, replicates, histogram, whole=True, width=width)
        if not sums.size:
            return [np.empty(0)] * replicates
        left, sums = sums[:, 2 * most :], sums[:, : 2 * most].reshape(replicates, 2, most).copy()
        shut = np.zeros((replicates, most), bool)
        for r in range(replicates if count else 0):
            at = np.searchsorted(cuts[r], gaps.low, side="right")
            sums[r, 0, at] += left[r]
            sums[r, 1, at] += left[r] > 0
            shut[r, at] = left[r] > 0
        near, finer, again = [], [], False
        for r in range(replicates):
            weight, rows = sums[r]
            full = np.flatnonzero(rows > 0)
            if not len(full):
                near.append(full), finer.append(cuts[r])
                continue
            at = np.minimum(np.searchsorted(np.cumsum(weight[full]), wanted * weight.sum(), side="right"), len(full) - 1)
            places = np.unique(np.clip((at[:, None] + np.array([-1, 0, 1])).ravel(), 0, len(full) - 1))
            cells = full[places]
            if shut[r, cells].any():
                return None
            lows, highs = np.concatenate(([0.0], cuts[r]))[cells], np.concatenate((cuts[r], [1.0]))[cells]
            wide = (rows[cells] > GATHERED) & (highs - lows > 1e-13)
            again |= bool(wide.any())
            more = [np.linspace(a, b, 66)[1:-1] for a, b in zip(lows[wide], highs[wide], strict=True)]
            near.append(cells), finer.append(np.unique(np.concatenate([cuts[r], *more])))
        if not again:
            break
        cuts, cut = finer, [_Cut(c, bool(count)) for c in finer]
    before = np.cumsum(sums[:, 0], axis=1) - sums[:, 0]

    looked = np.zeros((replicates, most), bool)
    for r in range(replicates):
        looked[r, near[r]] = True
    looked = looked.ravel()

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0

        def table() -> pd.DataFrame:
            at, score, weight, own = (np.concatenate(c) for c in zip(*kept, strict=True))
            # of equal scores the lightest row comes first and the heaviest last
            return pd.DataFrame({"replicate": at // most, "cell": at % most, "v": score, "w": weight, "least": own, "most": own})

        for frame in frames:
            for row in frame.itertuples():
                b, _ = met(Block.unpack(row, features))
                for at, places, score, weight in _placed(b, entries, cut, most):
                    keep = np.flatnonzero(looked[at])
                    kept.append((at[keep], score[keep], weight[keep], b.w[places[keep]]))
                    size += len(keep)
                if size > GATHERED * GATHERED:
                    yield table()
                    kept, size = [], 0
        if kept:
            yield table()

    with few_rows(blocks.sparkSession, 4):
        rows = blocks.mapInPandas(gather, "replicate int, cell int, v double, w double, least double, most double")
        per = rows.groupBy("replicate", "cell", "v").agg(F.sum("w").alias("w"), F.min("least").alias("least"), F.max("most").alias("most"))

        def edges(frame: pd.DataFrame) -> pd.DataFrame:
            r, frame = int(frame["replicate"].iloc[0]), frame.sort_values("v")
            w, cell = frame["w"].to_numpy(), frame["cell"].to_numpy()
            total = np.cumsum(w)
            start = np.searchsorted(cell, cell)
            upto = before[r, cell] + total - (total - w)[start]
            places = np.column_stack((upto - w + frame["least"] / 2, upto - frame["most"] / 2)).ravel() / sums[r, 0].sum()
            inner = np.unique(np.interp(wanted, places, np.repeat(frame["v"].to_numpy(), 2)))
            return pd.DataFrame({"replicate": [r], "edges": [inner]})

        found = {r.replicate: np.array(r.edges) for r in per.groupBy("replicate").applyInPandas(edges, "replicate int, edges array<double>").collect()}  # a row a replicate
    return [found.get(r, np.empty(0)) for r in range(replicates)]


def counted(entries: Entries, edges: list[np.ndarray], replicates: int, bins: int, split: bool) -> Callable[[Block], np.ndarray]:
    """Weights in each bin of label 1 and of label 0, or, unless ``split``, of all rows in the second place."""
    cut = [_Cut(e, True) for e in edges]

    def run(b: Block) -> np.ndarray:
        out = np.zeros((2, replicates * bins))
        for at, rows, _, weight in _placed(b, entries, cut, bins):
            first = b.y[rows] == 1 if split else np.zeros(len(rows), bool)
            _add(out[0], at[first], weight[first])
            _add(out[1], at[~first], weight[~first])
        return out.reshape(2, replicates, bins).transpose(1, 0, 2).reshape(replicates, -1)

    return run


def counts(blocks: DataFrame, entries: Entries, edges: list[np.ndarray], bounds: _Bounds, *, features: int, replicates: int, bins: int, split: bool) -> np.ndarray:
    """What :func:`counted` gives, over all blocks; rows that have one place under all models are added up by unit."""
    inner = np.unique(np.concatenate([np.empty(0), *edges]))
    marks = np.concatenate(([-1.0], inner, [2.0]))
    stretched = np.concatenate(([-40.0], np.log(np.clip(inner, 1e-15, 1) / np.clip(1 - inner, 1e-15, 1)), [40.0]))
    widest = np.sort(np.argsort(-np.diff(stretched), kind="stable")[:GAPS])
    gaps = _Gaps(marks[widest], marks[widest + 1])
    count, own = len(widest), counted(entries, edges, replicates, bins, split)

    def run(b: Block, out: np.ndarray) -> None:
        gap = gaps.of(*bounds.scores(b.x))
        near = b.rows(gap < 0)
        if len(near.y):
            out[:, : 2 * bins] += own(near)
        side = np.where(b.y == 1, 0, count) if split else count
        out[:, 2 * bins :] += bounds.weights(b, np.where(gap >= 0, gap + side, -1), 2 * count)

    sums = summed(blocks, features, replicates, run, whole=True, width=2 * bins + 2 * count)
    out = sums[:, : 2 * bins].reshape(replicates, 2, -1).copy()
    for r in range(replicates if out.size else 0):
        at = np.searchsorted(edges[r], gaps.low, side="right")
        for side in (0, 1):
            np.add.at(out[r, side], at, sums[r, 2 * bins + side * count :][:count])
    return out


def mixtures(
    reference: DataFrame, target: DataFrame, out_of_fold: Entries, whole: Entries, bounds: tuple[_Bounds, _Bounds], *, features: int, replicates: int, bins: int
) -> list[tuple[int, float | None, str | None]]:
    """``bounds`` are those of the reference's scores and of the target's."""
    edges = quantile_edges(reference, out_of_fold, features=features, replicates=replicates, bins=bins, bounds=bounds[0])

    ref = counts(reference, out_of_fold, edges, bounds[0], features=features, replicates=replicates, bins=bins, split=True)
    goal = counts(target, whole, edges, bounds[1], features=features, replicates=replicates, bins=bins, split=False)
    out = []
    for r in range(replicates):
        size = len(edges[r]) + 1
        if size < 2 or not ref.size or not goal.size or not ref[r, :, :size].sum(axis=1).all() or not goal[r].any():
            out.append((r, None, "reference scores are indistinguishable" if size < 2 else "no rows"))
            continue
        agent, human = (c / c.sum() for c in ref[r, :, :size] + 0.5)
        if 0.5 * np.abs(agent - human).sum() < LEAST_VARIATION:
            out.append((r, None, "reference score distributions are indistinguishable"))
            continue
        out.append((r, float(likeliest_shares(agent[None], human[None], goal[r, 1:, :size])[0]), None))
    return out


def refit_shares(
    reference: DataFrame, target: DataFrame, reference_draws: DataFrame, target_draws: DataFrame, *, group: str, features: list[str], label: str, weight: str, replicates: int, folds: int = 5, ridge: float = 3.0, bins: int = 20
) -> DataFrame:
    """``replicate, share, failure``: the mixture share of each resample, all models refitted.

    ``reference_draws`` has ``replicate, label, group, fold, copies`` (a copy of a group belongs to one fold),
    ``target_draws`` ``replicate, group, copies``.  In each replicate a model a fold is fitted
    on the copies of the other folds and scores its own, one on all copies scores the target;
    reference scores, cut at their pooled weighted quantiles, give the two histograms that
    the target's mixes.  A replicate fails, with its reason, where a fold lacks a class or the
    scores don't tell the classes apart.
    """
    models = replicates * (folds + 1)
    own = reference_draws.select(group, label, (F.col("replicate") * folds + F.col("fold")).cast("int").alias("model"), F.col("copies").cast("int").alias("copies"))

    def made(held: np.ndarray) -> np.ndarray:
        # a fold's model trains on the copies of the other folds, the last one on all
        drawn = held.reshape(len(held), replicates, folds)
        each = drawn.sum(axis=2, dtype=np.uint16, keepdims=True)
        return np.concatenate((each - drawn, each), axis=2).reshape(len(held), -1)

    y = F.col(label).cast("int")
    blocks = packed(reference, own, unit=[group, label], features=features, label=y, weight=F.col(weight), models=replicates * folds, made=made)
    goal = target_draws.groupBy(group, F.col("replicate").cast("int").alias("model")).agg(F.sum("copies").cast("int").alias("copies"))
    target_blocks = packed(target, goal, unit=[group], features=features, label=F.lit(0), weight=F.col(weight), models=replicates)
    fits = fit_many(blocks, features=features, models=models, ridge=ridge)
    ok = ~fits.failed.reshape(replicates, folds + 1).any(axis=1)

    def scored(b: Block, held: np.ndarray, replicate: np.ndarray, model: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        # a row meets the models that score a copy of its unit, no others
        places = np.arange(len(b.y))
        for unit, at in b.runs():
            k = np.flatnonzero(held[unit] * ok[replicate])
            if len(k):
                yield replicate[k], places[at], fits.scores(b.x[at], model[k]), b.w[at, None] * held[unit, k]

    by_fold, by_all = np.arange(replicates * folds), np.arange(replicates)

    def out_of_fold(b: Block) -> Iterator[tuple]:
        copies = b.copies.reshape(len(b.copies), replicates, folds + 1).astype(np.int64)
        own = (copies[:, :, folds:] - copies[:, :, :folds]).reshape(len(copies), -1)  # copies of a unit in each fold
        return scored(b, own, by_fold // folds, by_fold // folds * (folds + 1) + by_fold % folds)

    def whole(b: Block) -> Iterator[tuple]:
        return scored(b, b.copies, by_all, by_all * (folds + 1) + folds)

    if ok.any():
        beta = fits.beta.reshape(replicates, folds + 1, -1)
        bounds = (
            _Bounds.of(beta[:, :folds], ok, lambda b: b.copies.reshape(len(b.copies), replicates, folds + 1)[:, :, folds] * ok),
            _Bounds.of(beta[:, folds:], ok, lambda b: b.copies * ok),
        )
        found = mixtures(blocks, target_blocks, out_of_fold, whole, bounds, features=len(features), replicates=replicates, bins=bins)
    else:
        found = [(r, None, None) for r in range(replicates)]
    discard(blocks, target_blocks)
    rows = [(r, share, reason if ok[r] else "a fold lacks a class") for r, share, reason in found]
    return reference.sparkSession.createDataFrame(rows, "replicate int, share double, failure string")


def refit_interval(shares: DataFrame) -> DataFrame:
    """``replicates, successful, failed, low, high``: the percentile interval over the replicates that did not fail."""
    q = [F.percentile("share", F.lit(x)).alias(n) for n, x in (("low", 0.025), ("high", 0.975))]
    return shares.agg(F.count("*").alias("replicates"), F.count("share").alias("successful"), F.count("failure").alias("failed"), *q)
