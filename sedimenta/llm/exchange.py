"""Global counts of very many hashed keys, with few bytes moved a key.

Rows stand in blocks.  A block sends each of its distinct keys once, with its
count in the block, to the slice that the key's leading bits name.  A slice adds
up the counts of all blocks and sends each block the totals of its own keys, in
the order they came.  What moves is ``(bits - slice bits) / 8`` bytes a key and
block, stored byte plane by byte plane so that the slowly changing leading bytes
of sorted keys compress; a frequent key costs one entry a block, so no slice
grows with the rows that hold it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "block int, slice int, keys binary, counts binary"
TOTAL = "block int, slice int, totals binary"
#: Keys that a slice and text bytes that a block should hold, about.
SLICE_KEYS, BLOCK_BYTES = 1 << 20, 12 << 20


def planned(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """``(blocks, slice bits)`` for a table, from the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(16, -(-size // block_bytes)), max(8, (size // 4 // SLICE_KEYS).bit_length())


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def send(block: int, keys: np.ndarray, counts: np.ndarray, bits: int, slice_bits: int) -> pd.DataFrame:
    """The rows in which a block sends its sorted distinct keys (below ``2**bits``) and counts."""
    slices = np.arange(1 << slice_bits, dtype=np.uint64)
    starts = np.append(np.searchsorted(keys, slices << np.uint64(bits - slice_bits)), len(keys))
    full = np.flatnonzero(np.diff(starts))
    low = keys & np.uint64((1 << (bits - slice_bits)) - 1)
    width = -(-(bits - slice_bits) // 8)
    return pd.DataFrame({
        "block": np.int32(block),
        "slice": full.astype("int32"),
        "keys": [_planes(low[starts[s] : starts[s + 1]], width) for s in full],
        "counts": [_planes(counts[starts[s] : starts[s + 1]], 4) for s in full],
    })


def totals(sent: DataFrame, bits: int, slice_bits: int) -> DataFrame:
    """For each sent row the totals of its keys over all blocks, in the order of the keys.

    The first byte is the number of bytes a total, which the largest one of the row sets.
    """
    width = -(-(bits - slice_bits) // 8)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [_values(k, width) for k in rows["keys"]]
        counts = np.concatenate([_values(c, 4) for c in rows["counts"]])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(which, weights=counts)[which].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        parts = np.split(summed, ends[:-1])
        widths = [max(1, -(-int(p.max()).bit_length() // 8)) for p in parts]
        return pd.DataFrame({"block": rows["block"], "slice": rows["slice"], "totals": [bytes([w]) + _planes(p, w) for w, p in zip(widths, parts)]})

    return sent.groupBy("slice").applyInPandas(add, TOTAL)


def received(rows: pd.DataFrame) -> np.ndarray:
    """A block's totals, aligned with its sorted distinct keys."""
    ordered = rows.sort_values("slice")["totals"]
    return np.concatenate([_values(t[1:], t[0]) for t in ordered]) if len(ordered) else np.empty(0, np.uint64)

