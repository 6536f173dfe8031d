"""Byte-pair merging: token counts, encoding and decoding.

One merge routine serves both operators.  Symbols stand in a doubly linked list
(two integer arrays); adjacent pairs wait in a heap by merge rank, then by
position.  The lowest pair is popped, merged into its left symbol, and the two
new neighbours are pushed.  An entry whose pair has changed since it was pushed is
stale and skipped.  Symbols are numbers, a pair is one number, and so is a heap
entry, so nothing but integers is compared.

The token count of a text is the number of its first symbols less the number of
merges; no ids are made for it.

A text is cut where no merge can reach across, and the pieces between the cuts
are remembered in a bounded table of each Python worker, so a frequent word is
merged once.  Whole texts are read; very long pieces go through the same heap in
``n log n`` steps.

Defined results: null counts and encodes as the empty text (no tokens); repeated
rows give equal results; merges of one rank tie to the left; other columns pass
through, but for those that the result replaces; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.text import quoted, set_aside

#: Pieces remembered in each Python worker, and the longest one worth it.
REMEMBERED, LONGEST = 1 << 19, 64
#: A pair of symbols is ``left << WIDE | right``; no symbol is as large.
WIDE = 21


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Merges ``symbols`` in place and returns the number of merges; what is left has no -1.

    ``ranks`` gives the rank of a pair, ``made`` the symbol that the merge of a rank makes.
    """
    n = len(symbols)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    #: The rank of the pair that starts at each symbol.
    at = [get(a << WIDE | b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r * n + i for i, r in enumerate(at) if r >= 0]
    if not heap:
        return 0
    at.append(-1)
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, left = divmod(pop(heap), n)
        if at[left] != rank:
            continue
        right = after[left]
        symbols[left] = new = made[rank]
        symbols[right] = at[right] = -1
        merges += 1
        after[left] = follower = after[right]
        if follower < n:
            before[follower] = left
            at[left] = rank = get(new << WIDE | symbols[follower], -1)
            if rank >= 0:
                push(heap, rank * n + left)
        else:
            at[left] = -1
        first = before[left]
        if first >= 0:
            at[first] = rank = get(symbols[first] << WIDE | new, -1)
            if rank >= 0:
                push(heap, rank * n + first)
    return merges


class _Remembered(dict):
    """A bounded memo; a full table starts again from nothing."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece):
        value = self.compute(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = value
        return value


class PieceCounter:
    """Counts the tokens of a piece vocabulary with byte fallback, without ids.

    Spaces become the visible space mark, one more stands before the text, and
    a symbol outside the vocabulary costs its UTF-8 bytes.
    """

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]
        several = [p for p in pieces if len(p) > 1]
        if any(self.SPACE in p.lstrip(self.SPACE) for p in several):
            raise ValueError("a piece holds a space after other characters; words can't be cut apart")
        whole = set(pieces)
        self.cost = {c: 1 for c in pieces if len(c) == 1}
        # every way in which two symbols join to a piece; a symbol is a piece or one character
        self.symbols = {p: i for i, p in enumerate({*pieces, *"".join(several)})}
        self.other = len(self.symbols)
        self.made = [self.symbols[p] for p in pieces]
        self.ranks: dict[int, int] = {}
        for rank, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (cut == 1 or left in whole) and (cut == len(piece) - 1 or right in whole):
                    self.ranks[self.symbols[left] << WIDE | self.symbols[right]] = rank
        reached = set("".join(several))
        #: Characters that no merge touches also cut the text.
        self.alone = [c for c in "\n\r\t\x0b\x0c" if c not in reached]
        self.pieces = regex.compile(f"{self.SPACE}*[^{self.SPACE}{''.join(self.alone)}]+|{self.SPACE}+").findall
        self.known = _Remembered(self._count)

    def _cost(self, c: str) -> int:
        return self.cost.get(c) or len(c.encode())

    def _count(self, piece: str) -> int:
        get = self.symbols.get
        first = sum(map(self._cost, piece))
        # characters that no piece holds are alike: none of them merges
        return first - merge([get(c, self.other) for c in piece], self.ranks, self.made)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = self.SPACE + text.replace(" ", self.SPACE)
        alone = sum(marked.count(c) * self._cost(c) for c in self.alone)
        return alone + sum(map(self.known.__getitem__, self.pieces(marked)))


class WordCodec:
    """Encodes with word-end merges over bytes, and decodes to vocabulary strings.

    Reads the vocabulary, merges, word pattern, word-end mark and added tokens
    from the tokenizer's JSON file.  Text is composed (NFC) and letters are lowered
    one by one; added tokens are cut out of the raw text first.  No word reaches
    across white space, so the parts between are what is remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added_ids = added
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in added.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.blank = regex.compile(r"\p{White_Space}+").split
        #: Characters at which ``str.split`` cuts though they are no white space in the pattern.
        self.odd = regex.compile("[\x1c-\x1f]").search
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte = [chr(b) if b in printable else chr(next(spare)) for b in range(256)]
        # a symbol is its id; strings that the vocabulary lacks get numbers above
        number = dict(self.ids)
        self.byte = [number.setdefault(c, len(number) + len(added)) for c in byte]
        self.last = [number.setdefault(c + end, len(number) + len(added)) for c in byte]
        self.made = [number.setdefault(a + b, len(number) + len(added)) for a, b in model["merges"]]
        self.ranks = {number[a] << WIDE | number[b]: r for r, (a, b) in enumerate(model["merges"])}
        self.known_id = set(self.ids.values())
        self.lowered = _Lower()
        self.known, self.known_words = _Remembered(self._part), _Remembered(self._word)

    def _part(self, part: str) -> list[int]:
        """The ids of a part of a text without white space."""
        if part.isascii():
            part = part.lower()
        else:
            part = unicodedata.normalize("NFC", part).translate(self.lowered)
        head = part.rstrip(".,;:!?")
        if head.isalpha():  # one run of letters, then one of marks
            ids = self.known_words[head]
            return ids if head == part else ids + self.known_words[part[len(head) :]]
        words = self.words(part)
        return [i for w in words for i in self.known_words[w]]

    def _word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [self.byte[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if len(symbols) > 1:
            merge(symbols, self.ranks, self.made)
        return [s for s in symbols if s in self.known_id]

    def _plain(self, text: str, out: list[int]) -> None:
        parts = text.split() if not self.odd(text) else [p for p in self.blank(text) if p]
        for ids in map(self.known.__getitem__, parts):
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.added is None:
            self._plain(text, out)
            return out
        for part in self.added.split(text):
            if part in self.added_ids:
                out.append(self.added_ids[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class _Lower(dict):
    """Lower case of single characters, filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = low = chr(code).lower()
        return low


@lru_cache(maxsize=4)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=4)
def _codec(path: str) -> WordCodec:
    return WordCodec(path)


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of ``text`` (long) under the piece model at ``path``, a file on every machine."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(path)
        return pd.Series([counter(t) for t in texts], dtype="int64")

    return count(text)


def bpe_encode_decode(text: Column, path: str) -> Column:
    """Struct of ``ids`` (array of int) and ``decoded`` (string) under the tokenizer at ``path``."""

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(path)
        ids, decoded = [], []
        for t in texts:
            own = codec.encode(t)
            ids.append(np.array(own, np.int32))
            decoded.append(codec.decode(own))
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    return run(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        codec = _codec(path)
        return pd.Series([None if r is None else codec.decode(r) for r in rows], dtype=object)

    return run(ids)


def token_counts(docs: DataFrame, path: str, *, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    text = F.col(quoted(text_col))
    rows, names = set_aside(docs, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens=count_tokens(text, path))
    own = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    return rows.select(*own, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def bpe_digests(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the SHA-256 of the ids in decimal and of the decoded text."""
    coded, names = set_aside(docs, bpe=bpe_encode_decode(F.col(quoted(text_col)), path))
    return coded.select(
        *[F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")],
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
