"""Gradient-boosted trees of depth 2 for a binary label, several models side by side.

Every round adds a tree to each model by the gradients of the logistic loss: a pass over
the blocks of :mod:`refit` sums gradients by feature and bin for the first split, another
one inside both halves for the second.  Splits have the largest
``wl wr / (wl + wr) (mean_l - mean_r)^2`` of the residuals, leaves one Newton step.  Thresholds lie between
the distinct values of a feature, or between quantiles of one with more of them than bins.
Rows of the same bins, label and multiplicities have the same gradients, so they become one
row with their weights added before the first round; there are never more of these than bins allow.
Margins are written with the blocks now and then, so a pass applies a bounded number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.refit import BLOCK_ROWS, CHUNK_ROWS, Block, few_rows, summed
from sedimenta.plans.scratch import discard, materialize

#: Most bins of a feature, rounds between two writings of the margins, and blocks read by one task.
BINS, WRITTEN, TASK_BLOCKS = 256, 25, 8


def thresholds(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Sorted thresholds of each feature, fewer than ``bins``; nulls count as 0."""
    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    few = df.agg(*[F.approx_count_distinct(v).alias(f"c{i}") for i, v in enumerate(value.values())]).first()
    out = []
    for i, (f, v) in enumerate(value.items()):
        found = [r.v for r in df.select(v.alias("v")).distinct().orderBy("v").limit(bins + 1).collect()] if few[i] <= 2 * bins else []
        if not 0 < len(found) <= bins:
            # neighbours of each quantile stand for the values around it
            found = df.select(v.alias(f)).approxQuantile(f, [j / bins for j in range(bins + 1)], 0.1 / bins)
        values = np.unique(np.array(found, np.float64))
        out.append((values[:-1] + values[1:]) / 2)
    return out


@dataclass
class Tree:
    """For each model: the first split and those of both halves (feature, bin), and the values of the four leaves."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def margins(self, codes: np.ndarray, models: slice = slice(None)) -> np.ndarray:
        """A column a model."""
        numbers = range(*models.indices(len(self.value)))
        out = np.empty((len(codes), len(numbers)))
        for i, k in enumerate(numbers):
            right = codes[:, self.feature[k, 0]] > self.at[k, 0]
            low = codes[:, self.feature[k, 1]] > self.at[k, 1]
            high = codes[:, self.feature[k, 2]] > self.at[k, 2]
            out[:, i] = self.value[k][np.where(right, 2 + high, low)]
        return out


@dataclass
class Boosted:
    """Fitted models; ``failed`` where a class is missing."""

    features: list[str]
    borders: list[np.ndarray]
    start: np.ndarray
    failed: np.ndarray
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(self.borders)])

    def scores(self, x: np.ndarray, models: slice = slice(None)) -> np.ndarray:
        """Probabilities, a column a model, rounded so that a row has one score in every pass."""
        codes = self.codes(x)
        total = np.tile(self.start[models], (len(x), 1))
        for tree in self.trees:
            total += self.rate * tree.margins(codes, models)
        return np.round(1 / (1 + np.exp(-np.clip(total, -35, 35))), 12)


@dataclass
class _Coded(Block):
    """A block whose ``x`` are bins, with the margins of the trees that are already applied."""

    margin: np.ndarray

    @classmethod
    def unpack(cls, row, features: int) -> _Coded:
        b = Block.unpack(row, features)
        return cls(b.x, b.y, b.w, b.unit, b.copies, np.frombuffer(row.margin).reshape(len(b.y), -1))

    def chunks(self) -> Iterator[_Coded]:
        for i in range(0, len(self.y), CHUNK_ROWS):
            at = slice(i, i + CHUNK_ROWS)
            yield _Coded(self.x[at].astype(np.int64), self.y[at], self.w[at], self.unit[at], self.copies, self.margin[at])


def _written(blocks: DataFrame, features: int, make) -> DataFrame:
    """Coded ``blocks`` with new ``x`` and ``margin``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [make(_Coded.unpack(row, features)) for row in frame.itertuples()]
            rest = {c: pd.Series(frame[c].tolist(), dtype=object) for c in ("y", "w", "unit", "copies")}
            yield pd.DataFrame({"n": frame["n"].to_numpy(), "units": frame["units"].to_numpy(), "x": pd.Series([np.ascontiguousarray(x, np.float64).tobytes() for x, _ in made], dtype=object), **rest, "margin": pd.Series([np.ascontiguousarray(m).tobytes() for _, m in made], dtype=object)})

    with few_rows(blocks.sparkSession, 4):
        return materialize(blocks.mapInPandas(run, "n int, units int, x binary, y binary, w binary, unit binary, copies binary, margin binary"))


def _collapsed(blocks: DataFrame, model: Boosted) -> DataFrame:
    """The blocks' distinct rows of bins, label and multiplicities with the sums of their weights, in blocks of bins and first margins."""
    p, models = len(model.features), len(model.start)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                b = Block.unpack(row, p)
                same = np.column_stack((model.codes(b.x), b.y, b.copies[b.unit])).astype(np.uint16)
                raw = np.ascontiguousarray(same).view(np.dtype((np.void, same.shape[1] * 2))).ravel()
                kinds, at = np.unique(raw, return_inverse=True)
                yield pd.DataFrame({"cell": [k.tobytes() for k in kinds], "w": np.bincount(at, weights=b.w)})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[i : i + BLOCK_ROWS]
                rows = np.frombuffer(b"".join(part["cell"]), np.uint16).reshape(len(part), -1)
                copies, unit = np.unique(rows[:, p + 1 :], axis=0, return_inverse=True)
                one = {
                    "n": len(part), "units": len(copies), "x": rows[:, :p].astype(np.float64).tobytes(), "y": rows[:, p].astype(np.int8).tobytes(), "w": part["w"].to_numpy(np.float64).tobytes(),
                    "unit": unit.ravel().astype(np.int32).tobytes(), "copies": copies.tobytes(), "margin": np.tile(model.start, (len(part), 1)).tobytes(),
                }
                yield pd.DataFrame({k: [v] for k, v in one.items()})

    with few_rows(blocks.sparkSession, 4):
        distinct = materialize(blocks.mapInPandas(cells, "cell binary, w double").groupBy("cell").agg(F.sum("w").alias("w")))
    tasks = max(1, -(-distinct.count() // (TASK_BLOCKS * BLOCK_ROWS)))
    out = materialize(distinct.repartition(tasks, "cell").mapInPandas(pack, "n int, units int, x binary, y binary, w binary, unit binary, copies binary, margin binary"))
    discard(distinct)
    return out


def _split(sums: np.ndarray, borders: list[np.ndarray]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The best split of a node from its sums (feature, bin, [gradient, weight, curvature]): feature, bin, sums of both sides."""
    left = np.cumsum(sums, axis=1)
    total = left[0, -1]
    right = total - left
    wl, wr = left[..., 1], right[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = wl * wr / (wl + wr) * (left[..., 0] / wl - right[..., 0] / wr) ** 2
    allowed = (wl > 1e-12) & (wr > 1e-12 * np.abs(total[1]))
    for f, b in enumerate(borders):
        allowed[f, len(b) :] = False
    gain = np.where(allowed, gain, -1.0)
    f, j = divmod(int(gain.argmax()), gain.shape[1])
    if gain[f, j] < 0:  # nothing to split: all on the left
        return 0, sums.shape[1], total, np.zeros(3)
    return f, j, left[f, j], right[f, j]


def boost_many(blocks: DataFrame, borders: list[np.ndarray], *, features: list[str], models: int, rounds: int = 100, rate: float = 0.05) -> Boosted:
    """Boosted models over the blocks of :func:`refit.packed`, one for each column of multiplicities."""
    p, width = len(features), max(len(b) for b in borders) + 1

    def classes(b: Block) -> np.ndarray:
        m = b.copies[b.unit] * b.w[:, None]
        return np.column_stack((m[b.y == 1].sum(axis=0), m[b.y == 0].sum(axis=0)))

    totals = summed(blocks, p, models, classes)
    failed = (totals <= 0).any(axis=1) if totals.size else np.ones(models, bool)
    start = np.log(np.where(failed, 1.0, totals[:, 0] / np.where(failed, 1.0, totals[:, 1]))) if totals.size else np.zeros(models)
    out = Boosted(features, borders, start, failed, rate)
    if failed.all():
        return out
    coded = _collapsed(blocks, out)
    applied = 0

    def gradients(b: _Coded, trees: list[Tree]) -> tuple[np.ndarray, ...]:
        margin = b.margin + rate * sum((t.margins(b.x) for t in trees), np.zeros(1))
        prob = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        m = b.copies[b.unit] * b.w[:, None]
        return m * (b.y[:, None] - prob), m, m * prob * (1 - prob)

    def binned(b: _Coded, parts: tuple[np.ndarray, ...], place: np.ndarray, nodes: int) -> np.ndarray:
        sums = np.zeros((models, nodes, p, width, 3))
        for k in range(models):
            for f in range(p):
                at = place[:, k] * width + b.x[:, f]
                for i, part in enumerate(parts):
                    sums[k, :, f, :, i] = np.bincount(at, weights=part[:, k], minlength=nodes * width).reshape(nodes, width)
        return sums.reshape(models, -1)

    for _ in range(rounds):
        trees = out.trees[applied:]
        root = summed(coded, p, models, lambda b, trees=trees: binned(b, gradients(b, trees), np.zeros((len(b.y), models), np.int64), 1), _Coded).reshape(models, p, width, 3)
        feature, at = np.zeros((models, 3), np.int64), np.full((models, 3), width)
        for k in range(models):
            feature[k, 0], at[k, 0], _, _ = _split(root[k], borders)

        def halves(b: _Coded, trees=trees, feature=feature.copy(), at=at.copy()) -> np.ndarray:
            place = (b.x[:, feature[:, 0]] > at[:, 0]).astype(np.int64)
            return binned(b, gradients(b, trees), place, 2)

        inner = summed(coded, p, models, halves, _Coded).reshape(models, 2, p, width, 3)
        value = np.zeros((models, 4))
        for k in range(models):
            for side in (0, 1):
                feature[k, 1 + side], at[k, 1 + side], *sides = _split(inner[k, side], borders)
                value[k, 2 * side : 2 * side + 2] = [s[0] / s[2] if abs(s[2]) > 1e-150 else 0.0 for s in sides]
        out.trees.append(Tree(feature, at, value))
        if len(out.trees) - applied == WRITTEN and len(out.trees) < rounds:
            new = out.trees[applied:]
            after = _written(coded, p, lambda b, new=new: (b.x, b.margin + rate * sum(t.margins(b.x.astype(np.int64)) for t in new)))
            discard(coded)
            coded, applied = after, len(out.trees)
    discard(coded)
    return out
