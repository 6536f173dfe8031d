"""Phrases whose words stand together far more often than by chance, from weighted automata of n-grams.

Words are counted in blocks of documents.  Two passes find which words, then which
pairs of frequent words, can reach the least count: blocks send hashed keys with
their counts, slices of keys add them up (:mod:`exchange`), and what reaches the
least count is marked in a bitmap of bounded size.  Hashes and bitmap only let too
much through, never too little.  The third pass counts exactly, by the words themselves: each
block sorts its n-grams (those within runs of marked pairs) and builds count
transducers from them (:mod:`transducer`), one for each range of prefixes; a range
adds up the automata of all blocks and keeps the frequent n-grams.  Parts of phrases are looked
up by composing them with the automaton of the range that they fall in.

A range covers whole n-grams, not first words, so the n-grams after one very frequent
word spread over many ranges; a frequent n-gram is one path a block.  The borders
come from a bounded sample and only balance the work.  Bitmaps and borders are
what is broadcast: at most ``2**filter_bits / 8`` bytes, and a border for each
``range_bytes`` of text.  With more frequent n-grams than bits, more is
counted exactly, with the same result.

Defined results: null text counts as empty, null lang as ``und``; texts without words
yield nothing; rows count however often they repeat; scores tie by count, then by
the phrase's UTF-8 bytes; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm import exchange
from sedimenta.llm.shingles import _mix
from sedimenta.llm.transducer import CountTransducer, in_order, relabelled, union
from sedimenta.plans.scratch import materialize, small_batches

#: Text bytes that a block should hold, about, and bits of a key below those that name its slice.
BLOCK_BYTES, KEY_BITS = 16 << 20, 40
#: Documents and pairs a document from which the borders of ranges come.
SAMPLED, PAIRS = 4000, 8
UNKNOWN = "und"
_END = b"\xff"  # no UTF-8 text holds it
_TABLE = bytes((c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c) for c in range(256))


class _Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers, 0 where a piece ends, and the words by number."""
    marked = _END.join([*texts, b""]).translate(_TABLE).replace(_END, b" \xff ").split()
    numbers = _Numbers()
    return np.fromiter(map(numbers.__getitem__, marked), np.int64, len(marked)), list(numbers)


def _keys(words: list[bytes], lang: str, drop: int) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)) >> np.uint64(drop)


def _pair_keys(words: np.ndarray, pairs: np.ndarray, drop: int) -> np.ndarray:
    return _mix(_mix(words[pairs >> 32]) + words[pairs & 0xFFFFFFFF]) >> np.uint64(drop)


class Filter:
    """A bitmap over the leading bits of keys."""

    def __init__(self, data: np.ndarray, shift: int):
        self.data, self.shift = data, np.uint64(shift)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """``lang`` and texts of each block and language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _filter(sent: DataFrame, bits: int, slice_bits: int, filter_bits: int, least: int) -> Filter:
    """Marks the keys whose counts add up to ``least``."""
    width, low = -(-(bits - slice_bits) // 8), filter_bits - slice_bits

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([exchange._values(k, width) for k in rows["keys"]])
        counts = np.concatenate([exchange._values(c, 4) for c in rows["counts"]])
        distinct, which = np.unique(keys, return_inverse=True)
        frequent = distinct[np.bincount(which, weights=counts) >= least]
        marks = np.zeros(1 << low, np.uint8)
        marks[(frequent >> np.uint64(bits - filter_bits)).astype(np.int64)] = 1
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "marks": [np.packbits(marks).tobytes()]})

    out = np.zeros((1 << slice_bits, (1 << low) // 8), np.uint8)
    for row in sent.groupBy("slice").applyInPandas(mark, "slice int, marks binary").collect():  # 2**filter_bits bits together
        out[row.slice] = np.frombuffer(row.marks, np.uint8)
    return Filter(out.ravel(), bits - filter_bits)


def _frequent_pairs(numbers: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two words that are ``ok`` stand together, and both as one number."""
    at = np.flatnonzero(ok[numbers[:-1]] & ok[numbers[1:]])
    return at, numbers[at] << 32 | numbers[at + 1]


def _grams(numbers: np.ndarray, ok: np.ndarray, at: np.ndarray, which: np.ndarray, good: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and counts of the n-grams to count: words that are ``ok``, and runs of ``good`` pairs."""
    counts = np.bincount(numbers, minlength=len(ok))
    single = np.flatnonzero(ok & (counts > 0))
    rows = [np.pad(single[:, None], ((0, 0), (0, longest - 1)), constant_values=-1)]
    totals = [counts[single]]
    runs = np.zeros(len(numbers) + 1, bool)
    runs[at] = good[which]
    place, rank = at[good[which]], which[good[which]]
    for n in range(2, longest + 1):
        if n > 2:
            more = runs[place + n - 2]
            place = place[more]
            _, rank = np.unique(rank[more] << 32 | numbers[place + n - 1], return_inverse=True)
        _, first, total = np.unique(rank, return_index=True, return_counts=True)
        own = np.full((len(first), longest), -1, np.int64)
        own[:, :n] = numbers[place[first][:, None] + np.arange(n)]
        rows.append(own)
        totals.append(total)
    return np.concatenate(rows), np.concatenate(totals)


def _range_of(borders: list[tuple], lang: str, gram: tuple[bytes, ...]) -> int:
    return bisect_right(borders, (lang, *gram[:2]))


def _borders(rows: DataFrame, ranges: int) -> list[tuple]:
    """Borders ``(lang, word, word)`` of about equal ranges, from pairs of a bounded sample of documents."""
    n = rows.count()
    share = min(1.0, SAMPLED / max(1, n))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                words = text.translate(_TABLE).replace(_END, b" ").split()
                step = max(1, len(words) // PAIRS)
                found += [(lang, *pair) for pair in list(zip(words, words[1:], strict=False))[::step][:PAIRS]]
            yield pd.DataFrame(found, columns=["lang", "a", "b"], dtype=object)

    chosen = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    # the sample stays bounded when one text is repeated very often
    found = chosen.mapInPandas(some, "lang string, a binary, b binary").distinct().limit(2 * SAMPLED * PAIRS).collect()
    pairs = sorted((r.lang, bytes(r.a), bytes(r.b)) for r in found)
    return sorted({pairs[i * len(pairs) // ranges] for i in range(1, ranges)}) if pairs else []


def _sent(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, texts in _blocks(frames):
            yield from make(lang, *numbered(texts))

    return rows.mapInPandas(run, schema)


def _automata(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, filter_bits: int, range_bytes: int) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """Automata of all n-grams that occur ``least`` times (``range, lang, automaton``), words a language, borders of ranges."""
    small_batches(docs.sparkSession, 512)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slice_bits = max(6, (size // 4 // exchange.SLICE_KEYS).bit_length())
    bits = min(64, KEY_BITS + slice_bits)
    # of w words no more than w / least are frequent; 32 bits for each, as far as the bound goes
    filter_bits = max(slice_bits + 3, min(filter_bits, (32 * (size // 2) // least + (1 << 16)).bit_length()))
    sc, drop = docs.sparkSession.sparkContext, 64 - bits
    schema = f"{exchange.SENT}, lang string, n long"

    def send(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        distinct, which = np.unique(keys, return_inverse=True)
        return exchange.send(0, distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.uint64), bits, slice_bits).assign(lang=None, n=None)

    def words(lang: str, numbers: np.ndarray, known: list[bytes]) -> Iterator[pd.DataFrame]:
        counts = np.bincount(numbers, minlength=len(known))
        yield pd.DataFrame({"block": [0], "slice": [-1], "keys": [None], "counts": [None], "lang": [lang], "n": [int(counts[1:].sum())]})
        if len(known) > 1:
            yield send(_keys(known[1:], lang, drop), counts[1:])

    first = materialize(_sent(rows, words, schema))
    totals = first.filter("slice < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = sc.broadcast(_filter(first.filter("slice >= 0"), bits, slice_bits, filter_bits, least))

    def pairs(lang: str, numbers: np.ndarray, known: list[bytes]) -> Iterator[pd.DataFrame]:
        keys = _keys(known, lang, 0)
        ok = frequent.value(keys >> np.uint64(drop))
        ok[0] = False
        distinct, counts = np.unique(_frequent_pairs(numbers, ok)[1], return_counts=True)
        if len(distinct):
            yield send(_pair_keys(keys, distinct, drop), counts)

    paired = sc.broadcast(_filter(_sent(rows, pairs, schema), bits, slice_bits, filter_bits, least))
    ranges = max(8, -(-size // range_bytes))
    borders = _borders(rows, ranges)
    cut = sc.broadcast(borders)

    def build(lang: str, numbers: np.ndarray, known: list[bytes]) -> Iterator[pd.DataFrame]:
        keys = _keys(known, lang, 0)
        ok = frequent.value(keys >> np.uint64(drop))
        ok[0] = False
        at, both = _frequent_pairs(numbers, ok)
        distinct, which = np.unique(both, return_inverse=True)
        good = paired.value(_pair_keys(keys, distinct, drop)) if len(distinct) else np.zeros(0, bool)
        grams, counts = _grams(numbers, ok, at, which, good, longest)
        own, grams = relabelled(known, grams)
        order = in_order(grams)
        grams, counts = grams[order], counts[order]

        def gram(i: int) -> tuple[bytes, ...]:
            return tuple(own[w] for w in grams[i].tolist() if w >= 0)

        start = 0
        while start < len(grams):
            here = _range_of(cut.value, lang, gram(start))
            low, high = start, len(grams)
            while low + 1 < high:  # the last row of the range
                mid = (low + high) // 2
                low, high = (mid, high) if _range_of(cut.value, lang, gram(mid)) == here else (low, mid)
            made = CountTransducer.build(*relabelled(own, grams[start:high]), counts[start:high])
            yield pd.DataFrame({"range": [here], "lang": [lang], "automaton": [made.to_bytes()]})
            start = high

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(rows["range"].iloc[0], lang, union(map(CountTransducer.from_bytes, part), longest, least).to_bytes()) for lang, part in rows.groupby("lang")["automaton"]]
        return pd.DataFrame(found, columns=["range", "lang", "automaton"])

    kind = "range int, lang string, automaton binary"
    return materialize(_sent(rows, build, kind).groupBy("range").applyInPandas(add, kind)), materialize(totals), borders


def _listed(automata: DataFrame, longest: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, data in zip(frame["lang"], frame["automaton"], strict=True):
                one = CountTransducer.from_bytes(data)
                grams, counts = one.paths(longest)
                texts = [b" ".join(one.words[w] for w in g if w >= 0).decode("utf-8", "replace") for g in grams.tolist()]
                yield pd.DataFrame({"lang": pd.Series([lang] * len(texts), dtype=object), "phrase": pd.Series(texts, dtype=object), "words": (grams >= 0).sum(axis=1), "a": counts})

    return automata.mapInPandas(run, "lang string, phrase string, words int, a long")


def frequent_ngrams(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, filter_bits: int = 30, range_bytes: int = 64 << 20
) -> DataFrame:
    """``lang, phrase, words, a``: every n-gram that occurs at least ``least`` times in a language, and how often."""
    return _listed(_automata(docs, text_col, lang_col, least, longest, filter_bits, range_bytes)[0], longest)


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    covered_percent: int = 100,
    filter_bits: int = 30,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase's score is that of its weakest cut, ``floor(1000 a n / (l r))``; phrases that a longer
    one covers by ``covered_percent`` are left out.
    """
    automata, totals, borders = _automata(docs, text_col, lang_col, least, longest, filter_bits, range_bytes)
    cut = docs.sparkSession.sparkContext.broadcast(borders)
    phrases = materialize(_listed(automata, longest).filter("words > 1"))

    @F.pandas_udf("int")
    def range_of(langs: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([_range_of(cut.value, lang, tuple(p.encode().split(b" ", 2)[:2])) for lang, p in zip(langs, parts, strict=True)], dtype="int32")

    @F.pandas_udf("long")
    def score(a: pd.Series, n: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:
        # Python's integers: products may pass 64 bits
        return pd.Series([1000 * w * x // (y * z) for w, x, y, z in zip(a.tolist(), n.tolist(), l.tolist(), r.tolist(), strict=True)], dtype="int64")

    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("part")),
    )
    parts = cuts.select("lang", "phrase", "a", "cut", F.inline(sides)).withColumn("range", range_of("lang", "part"))

    def compose(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of = {lang: CountTransducer.from_bytes(data) for lang, data in zip(held["lang"], held["automaton"], strict=True)}
        weights = np.zeros(len(asked), np.int64)
        for lang, rows in asked.groupby("lang").indices.items():
            split = [p.encode().split(b" ") for p in asked["part"].iloc[rows]]
            known = sorted({w for p in split for w in p})
            number = {w: i for i, w in enumerate(known)}
            grams = np.array([[number[w] for w in p] + [-1] * (longest - len(p)) for p in split], np.int64).reshape(-1, longest)
            weights[rows] = of[lang].composed(known, grams)
        return pd.DataFrame({c: asked[c].to_numpy() if c in ("a", "cut") else pd.Series(asked[c].tolist(), dtype=object) for c in ("lang", "phrase", "a", "cut", "side")}).assign(f=weights)

    weighed = parts.groupBy("range").cogroup(automata.groupBy("range")).applyInPandas(compose, "lang string, phrase string, a long, cut int, side string, f long")
    both = weighed.groupBy("lang", "phrase", "a", "cut").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    scored = both.join(totals, "lang").withColumn("score", score("a", "n", "l", "r"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("worst"))

    size, start = F.col("size"), F.col("start")
    spans = phrases.filter("words > 2").select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = spans.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - size + 1)).alias("start"))
    cover = inner.groupBy("lang", F.array_join(F.slice(words, start, size), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(cover, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.col("worst.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "worst.n", "worst.score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
x AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS j FROM c),
s AS (SELECT x.lang, x.phrase, x.a, j, l.a AS l, r.a AS r, n, 1000::HUGEINT * x.a * n // (l.a::HUGEINT * r.a) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[j + 1:], ' ') JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda q: array_to_string(ws[q:q + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR longer < b.a QUALIFY rank <= 2000
"""
