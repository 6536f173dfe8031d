"""Language identification, words first, shorter and shorter character n-grams after.

The model is learnt relationally from labelled documents: per language the
relative frequencies of its ``top_words`` commonest words, and of its
``top_grams`` commonest character n-grams of each length from ``longest`` to 1
(words marked by ``<`` and ``>``).  A known word adds its smoothed log frequency
to every language; an unseen word adds the mean log frequency of its known
n-grams of the longest length that has any.

Bounds: documents are drawn by a hash of the id so that about ``docs_per_lang``
of each language are read for the counts; the model keeps the numbers above for
at most ``MOST_LANGS`` languages, so what is broadcast has a fixed largest size.
Prediction reads every whole text.

Defined results: a null text, and one without letters, is ``und`` with score 0;
so is every text if nothing could be learnt.  Ties go to the first language by
code point.  The score is the chosen language's share of probability after the
sum of log frequencies is divided by the square root of the number of words,
which keeps long texts from all reaching 1.  Repeated rows are predicted alike;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.text import quoted, set_aside

#: Largest number of languages in a model.
MOST_LANGS = 200
#: Unseen words remembered in each Python worker.
REMEMBERED = 1 << 17
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def learn(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 4000,
    top_words: int = 20000,
    top_grams: int = 4000,
    longest: int = 4,
) -> LangModel:
    """A model from the rows of ``docs`` with a text and a language."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    langs = {r.lang: r.n for r in per.orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return LangModel([], {}, [])
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in langs.items() for x in (lang, docs_per_lang / n)]), F.col(lang_col))
    drawn = (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
    words = (
        rows.filter(drawn)
        .select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
        .groupBy("lang", "item")
        .agg(F.count("*").alias("n"))
    )
    marked = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    grams = words.select("lang", "n", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size"))
    grams = (
        grams.filter(F.length("w") >= F.col("size"))
        .select("lang", "n", "size", F.explode(F.expr("transform(sequence(1, length(w) - size + 1), i -> substring(w, i, size))")).alias("item"))
        .groupBy("lang", "size", "item")
        .agg(F.sum("n").alias("n"))
    )
    items = words.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(grams.select("lang", "size", "item", "n"))
    order = W.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    kept = items.withColumn("r", F.row_number().over(order)).withColumn("all", F.sum("n").over(W.partitionBy("lang", "size")))
    kept = kept.filter(F.col("r") <= F.when(F.col("size") == 0, top_words).otherwise(top_grams))
    names = sorted(langs)
    at = {lang: i for i, lang in enumerate(names)}
    tables: list[dict[str, int]] = [{} for _ in range(longest + 1)]
    counts: list[list[tuple[int, int, int]]] = [[] for _ in range(longest + 1)]
    totals = np.ones((longest + 1, len(names)))
    for r in kept.select("lang", "size", "item", "n", "all").collect():  # bounded by the tops, lengths and languages
        table = tables[r.size]
        counts[r.size].append((table.setdefault(r.item, len(table)), at[r.lang], r.n))
        totals[r.size, at[r.lang]] = r["all"]
    logs = []
    for size, table in enumerate(tables):
        m = np.full((len(table), len(names)), 0.5)
        for row, lang, n in counts[size]:
            m[row, lang] += n
        logs.append(np.log(m / (totals[size] + 0.5 * max(1, len(table)))))
    return LangModel(names, tables[0], list(zip([{}, *tables[1:]], logs, strict=True)))


class LangModel:
    """Log frequencies by language; ``levels[0]`` is of words, ``levels[n]`` of n-grams."""

    def __init__(self, langs: list[str], words: dict[str, int], levels: list[tuple[dict[str, int], np.ndarray]]):
        self.langs, self.words, self.levels = langs, words, levels
        self.rows: _Rows | None = None

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words, "levels": self.levels, "rows": None}

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word by its longest known n-grams; zeros if none is known."""
        marked = f"<{word}>"
        for size in range(len(self.levels) - 1, 0, -1):
            table, logs = self.levels[size]
            known = [table[g] for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) in table]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if self.rows is None:
            self.rows = _Rows(self)
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), 20000):
            total += self.rows.sum(words[i : i + 20000])
        total /= np.sqrt(len(words))
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


class _Rows(dict):
    """Word to row of a matrix that grows by the unseen words met, and starts again when full."""

    def __init__(self, model: LangModel):
        super().__init__(model.words)
        self.model, self.base = model, len(model.words)
        self.matrix = np.empty((self.base + REMEMBERED, len(model.langs)))
        self.matrix[: self.base] = model.levels[0][1]
        self.used = self.base

    def __missing__(self, word: str) -> int:
        self.matrix[self.used] = self.model.backoff(word)
        self[word] = at = self.used
        self.used += 1
        return at

    def sum(self, words: list[str]) -> np.ndarray:
        if self.used + len(words) > len(self.matrix):
            self.clear()
            self.update(self.model.words)
            self.used = self.base
        return self.matrix[list(map(self.__getitem__, words))].sum(axis=0)


def identify(docs: DataFrame, model: LangModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    rows, names = set_aside(docs, lang=run(F.col(quoted(text_col))))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("lang_pred", "score")], "lang.lang_pred", "lang.score")


def held_out(doc_id: Column) -> Column:
    """True for the documents that nothing is learnt from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
