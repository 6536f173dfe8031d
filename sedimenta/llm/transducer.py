"""Acyclic automata over words whose final states carry counts.

An n-gram is a path, its count the weight of the path's last state.  Sorted n-grams
are added one after the other: what the next one does not share with the last is
finished, and a finished state equal to an earlier one (same weight, same arcs) is
that one, so the automaton is minimal at every step.  Rows of label numbers,
padded with -1, stand for n-grams outside the automaton.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np


class CountTransducer:
    def __init__(self, words: list[bytes], weight: np.ndarray, first: np.ndarray, label: np.ndarray, target: np.ndarray):
        #: Labels are numbers of ``words``, which is sorted; arcs of state ``s`` are ``first[s]`` to ``first[s + 1]``, by label.
        self.words, self.weight, self.first, self.label, self.target = words, weight, first, label, target
        self.arcs = np.repeat(np.arange(len(weight), dtype=np.int64), np.diff(first)) << 32 | label

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From rows in ascending order, each once; the root is the last state."""
        shared = np.zeros(len(grams), np.int64)
        if len(grams) > 1:
            shared[1:] = np.logical_and.accumulate((grams[1:] == grams[:-1]) & (grams[1:] >= 0), axis=1).sum(axis=1)
        register: dict[tuple, int] = {}
        path: list[list] = [[0]]  # weight, then label and target of each arc
        labels: list[int] = []

        def finish(depth: int) -> None:
            while len(path) - 1 > depth:
                state = register.setdefault(tuple(path.pop()), len(register))
                path[-1] += (labels.pop(), state)

        for same, gram, size, count in zip(shared.tolist(), grams.tolist(), (grams >= 0).sum(axis=1).tolist(), counts.tolist(), strict=True):
            finish(same)
            for symbol in gram[same:size]:
                labels.append(symbol)
                path.append([0])
            path[-1][0] = count
        finish(0)
        states = [*register, tuple(path[0])]
        first = np.zeros(len(states) + 1, np.int64)
        np.cumsum([len(s) // 2 for s in states], out=first[1:])
        arcs = np.array([x for s in states for x in s[1:]], np.int32).reshape(-1, 2)
        return cls(words, np.array([s[0] for s in states], np.int64), first, arcs[:, 0], arcs[:, 1])

    def paths(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and counts of all n-grams of at most ``longest`` words."""
        states, rows = np.array([len(self.weight) - 1]), np.full((1, longest), -1, np.int32)
        grams, counts = [], []
        for depth in range(longest):
            n = self.first[states + 1] - self.first[states]
            arc = np.repeat(self.first[states] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = np.repeat(rows, n, axis=0)
            rows[:, depth] = self.label[arc]
            states = self.target[arc]
            final = self.weight[states] > 0
            grams.append(rows[final])
            counts.append(self.weight[states[final]])
        return np.concatenate(grams), np.concatenate(counts)

    def composed(self, words: list[bytes], grams: np.ndarray) -> np.ndarray:
        """Weights of the rows ``grams`` over ``words``: both sides walk in step; 0 where a path ends early."""
        number = {w: i for i, w in enumerate(self.words)}
        own = np.array([*(number.get(w, -2) for w in words), -1], np.int64)[grams]
        at = np.full(len(grams), len(self.weight) - 1, np.int64)
        for depth in range(grams.shape[1]):
            going = np.flatnonzero((own[:, depth] != -1) & (at >= 0))
            wanted = at[going] << 32 | np.maximum(own[going, depth], 0)
            arc = np.minimum(np.searchsorted(self.arcs, wanted), max(len(self.arcs) - 1, 0))
            hit = (own[going, depth] >= 0) & (self.arcs[arc] == wanted) if len(self.arcs) else np.zeros(len(going), bool)
            at[going] = np.where(hit, self.target[arc] if len(self.arcs) else 0, -1)
        return np.where(at >= 0, self.weight[np.maximum(at, 0)], 0)

    def to_bytes(self) -> bytes:
        return pickle.dumps((b" ".join(self.words), self.weight, self.first, self.label, self.target))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        words, *arrays = pickle.loads(data)
        return cls(words.split(b" ") if words else [], *arrays)


def relabelled(words: list[bytes], grams: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Only the words that occur, sorted, and the rows with their numbers."""
    used = np.unique(grams)
    used = used[used >= 0]
    used = np.array(sorted(used.tolist(), key=words.__getitem__), np.int64)
    number = np.full(len(words) + 1, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    return [words[i] for i in used.tolist()], number[grams]


def in_order(grams: np.ndarray) -> np.ndarray:
    """Positions that sort the rows; a row stands before those it begins."""
    return np.lexsort(grams.T[::-1])


def union(parts: Iterable[CountTransducer], longest: int, least: int = 1) -> CountTransducer:
    """The automaton of all n-grams of the parts with their summed weights, of those that reach ``least``."""
    number: dict[bytes, int] = {}
    rows, counts = [np.empty((0, longest), np.int32)], [np.empty(0, np.int64)]
    for part in parts:
        grams, weights = part.paths(longest)
        own = np.array([*(number.setdefault(w, len(number)) for w in part.words), -1], np.int32)
        rows.append(own[grams])
        counts.append(weights)
    grams, weights = np.concatenate(rows), np.concatenate(counts)
    words, grams = relabelled(list(number), grams)
    order = in_order(grams)
    grams, weights = grams[order], weights[order]
    starts = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]).any(axis=1))) if len(grams) else np.empty(0, np.int64)
    summed = np.add.reduceat(weights, starts) if len(starts) else weights
    keep = summed >= least
    words, grams = relabelled(words, grams[starts][keep])
    return CountTransducer.build(words, grams, summed[keep])
