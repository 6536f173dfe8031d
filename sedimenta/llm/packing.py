"""Packing documents into as few sequences of a fixed length as possible.

Documents become token ids and one end id; only those longer than a sequence are
cut, into whole sequences but for the first piece.  Pieces are placed by the
squares of the counts of open sequences: with ``N(g)`` open sequences of gap ``g``,
a piece of length ``s`` goes where the sum of ``N(g)`` squared becomes smallest,
that is, from a gap that many sequences have to one that few have.  Longest
pieces come first, and a new sequence is opened only where no open one has room
for the piece, which the plain rule would do more often; on documents this stays
within a thousandth of ``tokens / capacity``.

Pieces are dealt to shards of about ``shard_rows`` by a random number that is
written with them, so a shard is bounded whatever the ids and repeats, and is
packed in one task of a few megabytes.  Pieces of sequences that a shard left emptier
than ``1 - reopen`` are dealt and packed once more, all shards' together.  Only
lengths and digests move; texts stay in the scan.

Defined results: null text counts as empty (its end id alone); ids may be null or
repeated, every row is packed; an end of text written in a text becomes its id, as
the tokenizer does by default; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.text import free_name
from sedimenta.plans.scratch import materialize, small_batches


class ByteEncoder:
    """Ids of the byte-level vocabulary at ``path`` (tokenizers JSON), as uint32 arrays.

    Where the same vocabulary stands beside it as ranks, Latin-1 texts, on which
    both libraries' patterns agree, go the faster way; all others go through ``path``.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            added = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            if self.slow.get_vocab_size(with_added_tokens=True) != len({*ranks.values(), *added.values()}):
                raise ValueError("the two files hold different vocabularies")
            self.added = set(added)
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.fast.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str | None) -> ByteEncoder:
    return ByteEncoder(path, ranks_path)


def token_pieces(
    docs: DataFrame, path: str, *, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece, and its ``ids`` if asked for.

    ``start`` counts the document's ids before the piece; the digest is the CRC-32
    of the ids as little-endian 32-bit numbers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, ranks_path), np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encoder(text).astype("<u4", copy=False), end))
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    part = ids[a:b]
                    for column, value in zip(out, (key, n, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kind = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encode, kind)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sequence of each piece, its offset, fill of each sequence)`` by the rule of the module."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences of each gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gap_of: list[int] = []
    never = np.iinfo(np.int64).max
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        # from gap g to g - size the sum of squares changes by 2 (1 - N(g) + N(g - size)); a full sequence counts no more
        change = count[: capacity + 1 - size] - count[size:] + 1
        change[0] = -count[size]
        change[count[size:] == 0] = never
        left = int(change.argmin())
        if change[left] == never:
            own, left = len(gap_of), capacity - size
            gap_of.append(capacity)
        else:
            own = waiting[left + size].pop()
            count[left + size] -= 1
        sequence[at], offset[at] = own, capacity - gap_of[own]
        gap_of[own] = left
        if left:
            count[left] += 1
            waiting[left].append(own)
    return sequence, offset, capacity - np.array(gap_of, np.int64)


def pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = 2048, shard_rows: int = 1 << 14, reopen: float = 0.05, seed: int = 20) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence is longer than ``capacity``.

    Lengths are from 1 to ``capacity``; others are an error.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("the table already has a column sequence_id or offset")
    own = [F.col(f"`{c}`") for c in pieces.columns]
    deal, shard, poor = (free_name(n, pieces.columns) for n in ("deal", "shard", "poor"))
    table = materialize(pieces.withColumn(deal, F.rand(seed)))
    length = F.col(f"`{length_col}`")
    counts = table.agg(F.count_if(length == capacity).alias("full"), F.count("*").alias("n"), F.count_if((length < 1) | (length > capacity) | length.isNull()).alias("bad")).first()
    if counts.bad:
        raise ValueError(f"{counts.bad} pieces are not from 1 to {capacity} long")
    full = table.filter(length == capacity).select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(df: DataFrame, rows: int, turn: int) -> DataFrame:
        shards = -(-rows // shard_rows) or 1

        def run(part: pa.Table) -> pa.Table:
            sequence, offset, fill = place(part[length_col].to_numpy(), capacity)
            base = (turn << 56) + (part[shard][0].as_py() << 32)
            out = part.drop_columns([shard])
            for name, value in (("sequence_id", sequence + base), ("offset", offset), (poor, fill[sequence] < (1 - reopen) * capacity)):
                out = out.append_column(name, pa.array(value))
            return out

        kind = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(poor, T.BooleanType())])
        return df.withColumn(shard, F.floor(F.col(deal) * shards).cast("int")).groupBy(shard).applyInArrow(run, kind)

    first = materialize(packed(table.filter(length < capacity), counts.n - counts.full, 1))
    again = first.filter(F.col(poor)).drop("sequence_id", "offset", poor)
    last = packed(again, again.count(), 2)
    results = [*own, F.col("sequence_id"), F.col("offset")]
    return full.unionByName(first.filter(~F.col(poor)).select(*results)).unionByName(last.select(*results))


def assembled(packed: DataFrame, *, ids_col: str = "ids") -> DataFrame:
    """``sequence_id, ids, starts``: the sequences of a packed table that carries its ids, and where each piece starts."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(f"`{ids_col}`").alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
