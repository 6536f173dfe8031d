"""Stupid-backoff scores of whole documents from n-gram counts of all others.

Counts of all n-grams up to ``order`` are gathered in tables partitioned by the
hash of the n-gram (:mod:`exchange`), joined back to the n-grams of each document,
less the document's own counts, and summed per document:

    S(w | h) = f(h w) / f(h)              if f(h w) > 0
             = ALPHA * S(w | shorter h)   otherwise
    S(w)     = max(f(w), UNSEEN) / N

Words are the runs of anything but ASCII white space, A-Z lowered.  A history
does not reach before its document's first word.  The counts grow with the input
and are never gathered in one place; a frequent n-gram costs one entry a block of
documents.

A key is the hash of its n-gram, cut to 48 bits and one more for each doubling of
the number of slices; with about a million keys a slice, one n-gram in a million or
so meets another one's count.

Defined results: null and empty texts have 0 words and score 0; if no other
document has words, N counts as 1; documents repeated word for word count for
each other; rows without an id and repeated ids are scored row by row;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import exchange
from sedimenta.llm.shingles import sequences, word_hashes
from sedimenta.plans.scratch import small_batches

ALPHA, UNSEEN, BLOCK_BYTES = 0.4, 0.5, 6 << 20
_SCORED = "id long, n_words long, n_backoff long, log_score double"
#: The empty n-gram, whose count is the number of words.
_EMPTY = np.uint64(0x2545F4914F6CDD1D)


def _grams(texts: pd.Series, order: int, drop: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Document of each word; for n from 0 to ``order`` the key of the n-gram that ends there; the mask of real ones.

    Where fewer than ``n`` words stand before, the key is that of the empty n-gram.
    """
    words = [word_hashes(t) for t in texts]
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    within = np.arange(len(flat)) - np.repeat(np.cumsum([0, *map(len, words)])[:-1], [len(w) for w in words])
    keys = [np.full(len(flat), _EMPTY >> np.uint64(drop))]
    for n in range(1, order + 1):
        k = keys[0].copy()
        ends = sequences(flat, n) >> np.uint64(drop)
        k[n - 1 :] = np.where(within[n - 1 :] >= n - 1, ends, k[n - 1 :]) if len(flat) >= n else k[n - 1 :]
        keys.append(k)
    return doc, keys, within


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """``id, n_words, n_backoff, log_score`` of every row.

    ``n_backoff`` counts the words whose longest n-gram occurs in no other
    document; ``log_score`` is the sum of ``ln S``.
    """
    small_batches(docs.sparkSession, 1024)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks, slice_bits = exchange.planned(rows, "text", BLOCK_BYTES)
    bits = min(64, 48 + slice_bits - 8)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def real(keys: list[np.ndarray], within: np.ndarray) -> np.ndarray:
        return np.concatenate([keys[0], *[k[within >= n - 1] for n, k in enumerate(keys) if n]])

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        _, keys, within = _grams(frame["text"], order, 64 - bits)
        k, counts = np.unique(real(keys, within), return_counts=True)
        return exchange.send(frame["block"].iloc[0], k, counts, bits, slice_bits)

    def judge(frame: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        doc, keys, within = _grams(frame["text"], order, 64 - bits)
        _, which = np.unique(real(keys, within), return_inverse=True)
        totals = exchange.received(back).astype(np.float64)[which]
        others, start = [], 0
        for n in range(order + 1):
            here = np.arange(len(doc)) if n == 0 else np.flatnonzero(within >= n - 1)
            at, total = which[start : start + len(here)], totals[start : start + len(here)]
            start += len(here)
            left = np.zeros(len(doc))
            # an n-gram that occurs once is the document's own
            more = np.flatnonzero(total > 1)
            _, again, own = np.unique(doc[here[more]] * (len(which) + 1) + at[more], return_inverse=True, return_counts=True)
            left[here[more]] = total[more] - own[again]
            others.append(left)
        value = np.maximum(others[1], UNSEEN) / np.maximum(others[0], 1)
        for n in range(2, order + 1):
            before = np.concatenate(([0.0], others[n - 1][:-1]))
            longer = others[n] / np.maximum(before, 1)
            value = np.where(within < n - 1, value, np.where(others[n] > 0, longer, ALPHA * value))
        longest = np.minimum(within + 1, order)
        seen = np.choose(longest, others) if len(doc) else np.empty(0)
        size = len(frame)
        return pd.DataFrame({
            "id": frame["id"].astype("Int64").to_numpy(),
            "n_words": np.bincount(doc, minlength=size).astype("int64"),
            "n_backoff": np.bincount(doc, weights=seen <= 0, minlength=size).astype("int64"),
            "log_score": np.bincount(doc, weights=np.log(value), minlength=size),
        })

    sent = placed.groupBy("block").applyInPandas(emit, exchange.SENT)
    back = exchange.totals(sent, bits, slice_bits)
    return placed.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(judge, _SCORED)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS f0, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS f1,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) ELSE 0 END AS f2,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) ELSE 0 END AS f3 FROM g),
h AS (SELECT *, lag(f1) OVER w AS h1, lag(f2) OVER w AS h2, greatest(f1, 0.5::DOUBLE) / greatest(f0, 1) AS v1 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v2 AS (SELECT *, CASE WHEN i < 2 THEN v1 WHEN f2 > 0 THEN f2 / greatest(h1, 1) ELSE 0.4::DOUBLE * v1 END AS v2 FROM h),
v3 AS (SELECT *, CASE WHEN i < 3 THEN v2 WHEN f3 > 0 THEN f3 / greatest(h2, 1) ELSE 0.4::DOUBLE * v2 END AS v3 FROM v2),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (CASE WHEN i = 1 THEN f1 WHEN i = 2 THEN f2 ELSE f3 END <= 0) AS n_backoff, sum(ln(v3)) AS log_score FROM v3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_score, 0), 6) AS log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
