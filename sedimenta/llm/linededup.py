"""Removing repeated and nearly repeated lines, by an exact set-similarity join.

A line's tokens are its distinct runs of ``words`` words, where a word is anything
but ASCII white space, lower-cased.  Lines are ordered by document id (null last),
hash of the text, and line number.  A line of at least ``words`` words or
``least_chars`` characters is removed if an earlier line has the same words, or a
Jaccard similarity of tokens of at least ``percent``; whether the earlier line is
itself removed does not matter, so the result does not depend on the order of work.

Only DataFrame functions are used:

1.  Each line gets the hash of its words and its first ``n - ceil(0.75 n) + m``
    tokens in the order of hashes, with ``m`` one more than a sixteenth of ``n``.
    Similar lines meet there in as many tokens as the shorter one has for ``m``,
    whatever the common order, so contents that meet others in fewer are done; they
    are most.  The first line of each content stands for it.
2.  The few lines left are tokenized again and keep all their tokens.  A line similar
    to another shares ``ceil(0.75 n)`` of these with lines left; others are done too.
3.  The shared tokens of the rest are ordered by rarity, which puts common passages
    last, and the first ones are kept, as many as similar lines need to meet.
4.  Each line is held against one earlier line, the first holder that most of these
    tokens name, so a mass of near copies goes out without pairs among its members.
5.  Lines without a match meet all earlier lines in these tokens.

Length, positional and rarity bounds stand in the conditions of the joins.

Defined results: null texts stay null; shorter and blank lines stay; a line of
fewer words than a token has no tokens and matches equal lines only; rows repeated
with one id and text are treated alike; a very long text costs in proportion to its
length; an empty table gives an empty table; other columns, whatever their names,
pass through, but for ``n_lines`` and ``removed_lines``, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.text import quoted, set_aside
from sedimenta.plans.scratch import discard, materialize, release

#: What stands between words, and around a line.
SPACE, AROUND = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def _hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _tokens(lines: DataFrame, words: int, *own: str) -> DataFrame:
    """``own`` columns and ``toks``, sorted, from the word hashes ``one``: distinct hashes of its runs of ``words`` words."""
    starts = F.slice("one", F.lit(1), F.greatest(F.size("one") - (words - 1), F.lit(0)))
    hashes = F.transform(starts, lambda first, i: F.xxhash64(first, *[F.get(F.col("one"), i + k) for k in range(1, words)]))
    return lines.select(*own, F.sort_array(F.array_distinct(hashes)).alias("toks"))


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100).cast("int")


def _meets(n: Column) -> Column:
    """How many tokens more than none lines of ``n`` tokens shall meet in; not less for more tokens, and at most ``n`` if that is above 0."""
    return 1 + F.shiftright(n, 4)


def _position(id_col: str = "id") -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_hash"), F.col("line_no"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _unsorted(keys: DataFrame) -> DataFrame:
    """``keys``, unique in what they are joined by, as the side that is held by hash: the larger side is not sorted then."""
    return keys.hint("shuffle_hash")


def _words(line: Column) -> Column:
    """The words of a line; most lines have single spaces only and need no pattern."""
    plain = F.lower(F.btrim(line, F.lit(AROUND)))
    other = F.lit(False)
    for mark in ("  ", *AROUND[1:]):
        other = other | F.contains(line, F.lit(mark))
    return F.when(other, F.split(plain, SPACE)).otherwise(F.split(plain, " "))


def _possible(x: str, y: str, percent: int) -> Column:
    """Order, length, positional and rarity bounds for line ``x`` and an earlier ``y`` that meet in a token."""
    nx, ny, ax, ay = (F.col(f"{s}.{c}") for c in ("n", "at") for s in (x, y))
    most = F.least(ax, ay) + F.least(nx - ax, ny - ay)
    most = F.least(most, nx - F.col(f"{x}.alone"), ny - F.col(f"{y}.alone"))
    return (F.col(f"{y}.pos") < F.col(f"{x}.pos")) & (100 * most >= percent * (nx + ny - most)) & (100 * nx >= percent * ny) & (100 * ny >= percent * nx)


def repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    words: int = 5,
    least_chars: int = 20,
) -> DataFrame:
    """``id, text_hash, lines``: the sorted numbers (from 0) of the lines to remove, of documents with any."""
    spark = docs.sparkSession
    id_name, text = quoted(id_col), quoted(text_col)
    base = docs.select(F.col(id_name).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    # 1. content hashes and first tokens of all lines; the first line of each content, and all later ones
    own = ("id", "text_hash", "line_no", "h1", "h2")
    split = base.filter(F.col("text").isNotNull()).select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    long = F.length(F.btrim("line", F.lit(AROUND))) >= least_chars
    ws = split.select("id", "text_hash", "line_no", long.alias("long"), _words(F.col("line")).alias("ws")).filter(F.col("long") | (F.size("ws") >= words))
    one = ws.select("id", "text_hash", "line_no", _hashed(F.col("ws")).alias("one"))
    hashed = one.select("id", "text_hash", "line_no", F.xxhash64("one").alias("h1"), F.xxhash64(F.lit(1), "one").alias("h2"), "one")
    n = F.size("toks")
    lines = materialize(_tokens(hashed, words, *own).select(*own, n.alias("n"), F.slice("toks", F.lit(1), n - _need(n, percent) + _meets(n)).alias("low")))
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(_position()).alias("pos"), F.count("*").alias("copies")))
    later = materialize(lines.select(*own).join(_unsorted(firsts), ["h1", "h2"]).filter(_position() != F.col("pos")).select("id", "text_hash", "line_no"))
    release(spark)
    low = lines.select("h1", "n", F.explode("low").alias("tok"))
    shared = materialize(low.groupBy("tok").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("tok"))
    release(spark)
    # each copy of a content brings its tokens
    hits = materialize(low.join(_unsorted(shared), "tok").groupBy("h1").agg(F.count("*").alias("hits"), F.min("n").alias("n")))
    discard(lines, shared)
    release(spark)

    # 2. all tokens of the lines left
    able = firsts.join(hits, "h1").filter(F.col("hits") >= F.col("copies") * _meets(_need(F.col("n"), percent)))
    at = able.groupBy(F.col("pos.id").alias("i"), F.col("pos.text_hash").alias("t")).agg(F.collect_list("pos.line_no").alias("at"))
    # only the lines asked for are carried on: a row would else hold its whole text once a line
    again = base.join(_unsorted(at), _same("id", "i") & _same("text_hash", "t")).select("id", "text_hash", "at", F.split("text", "\n").alias("rows"))
    # rows are named twice, as a column named once is written into the function, which would cut the text once a line
    asked = F.transform("at", lambda a: F.struct(a.alias("line_no"), F.get(F.col("rows"), F.least(a, F.size("rows"))).alias("row")))
    each = again.select("id", "text_hash", F.inline(asked))
    ws = each.select(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line_no").alias("pos"), _words(F.col("row")).alias("ws"))
    # a written number stands for the line from here on; a document that stands several times brings its lines as often, which only repeats pairs
    one = ws.select("pos", _hashed(F.col("ws")).alias("one"))
    left = materialize(_tokens(one, words, "pos").select(F.monotonically_increasing_id().alias("line"), "pos", "toks", F.size("toks").alias("n")))
    discard(firsts, hits)
    release(spark)

    # 3. shared tokens by rarity: how many lines hold one, before 48 bits of it; tokens that agree in both only bring more pairs
    n = F.col("n")
    each = left.select("line", F.explode("toks").alias("tok"))
    rarity = each.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    ranks = F.shiftleft(F.least("df", F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("tok", 16))
    # dealt by line before, as lists begun for each part of the tokens would hold a token or two
    by = each.join(_unsorted(rarity), "tok").select("line", ranks.alias("tok")).repartition("line").groupBy("line").agg(F.sort_array(F.collect_list("tok")).alias("by"))
    alone = n - F.size("by")
    ranked = left.join(by, "line").filter(F.size("by") >= _need(n, percent))
    ranked = materialize(ranked.select("line", "pos", "n", "toks", alone.alias("alone"), F.slice("by", F.lit(1), n - _need(n, percent) + 1 - alone).alias("by")))
    discard(left)
    release(spark)
    prefix = ranked.select("line", "pos", "n", "alone", F.posexplode("by").alias("i", "tok")).select("line", "pos", "n", "alone", (F.col("alone") + F.col("i") + 1).alias("at"), "tok")

    # 4. one earlier line for each: the first holder that most of its tokens name
    named = materialize(_similar(ranked, _named(prefix, prefix, percent), percent))
    release(spark)

    # 5. the others meet all earlier lines
    pairs = prefix.join(named, "line", "left_anti").alias("x").join(prefix.alias("y"), (F.col("x.tok") == F.col("y.tok")) & _possible("x", "y", percent))
    near = named.union(_similar(ranked, pairs.select(F.col("x.line").alias("line"), F.col("y.line").alias("other")).distinct(), percent)).distinct()

    gone = ranked.join(near, "line", "left_semi").select("pos.id", "pos.text_hash", "pos.line_no")
    out = materialize(later.unionByName(gone).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("lines")))
    discard(later, ranked, named)
    release(spark)
    return out


def _named(lines: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """``line, other``: for each of ``lines`` the earlier line that most of its tokens name as their first holder."""
    head = holders.groupBy("tok").agg(F.min(F.struct("pos", "line", "n", "at", "alone")).alias("y")).select("tok", "y.*").alias("y")
    votes = lines.alias("x").join(head, (F.col("x.tok") == F.col("y.tok")) & _possible("x", "y", percent)).groupBy(F.col("x.line").alias("line"), F.col("y.line").alias("other")).agg(F.count("*").alias("votes"))
    return votes.groupBy("line").agg(F.max_by("other", F.struct("votes", "other")).alias("other"))


def _similar(left: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``line`` of those pairs whose sets are similar enough."""
    # one shuffle of the sets by line serves both sides
    sets = left.select("line", "toks")
    both = F.size(F.array_intersect("m.toks", "t.toks"))
    met = pairs.alias("p").join(sets.alias("m"), F.col("p.line") == F.col("m.line")).join(sets.alias("t"), F.col("p.other") == F.col("t.line"))
    return met.filter(100 * both >= percent * (F.size("m.toks") + F.size("t.toks") - both)).select(F.col("p.line").alias("line")).distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = 5, least_chars: int = 20) -> DataFrame:
    """``docs`` with the repeated lines cut out of the text, ``n_lines`` and ``removed_lines`` (numbers from 0)."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, percent=percent, words=words, least_chars=least_chars).withColumnsRenamed({"id": "__id", "text_hash": "__hash", "lines": "__gone"})
    kept, names = set_aside(docs, __text=F.xxhash64(quoted(text_col)))
    joined = kept.join(_unsorted(gone), _same(names[id_col], "__id") & _same("__text", "__hash"), "left")
    # the lines are a column: written into a function of each line, the text would be cut once a line
    joined = joined.withColumn("__rows", F.split(F.col(names[text_col]), "\n"))
    stay = F.filter("__rows", lambda _, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(names[text_col])).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *[(text if c == text_col else F.col(n)).alias(c) for c, n in names.items() if c.lower() not in ("n_lines", "removed_lines")],
        F.coalesce(F.size("__rows"), F.lit(0)).alias("n_lines"),
        F.coalesce("__gone", F.array().cast("array<int>")).alias("removed_lines"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line_no, length(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS long, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM l),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, line_no) AS pos FROM w WHERE len(ws) >= 5 OR long >= 20),
s AS (SELECT pos, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS tok FROM c),
firsts AS (SELECT min(pos) AS pos, array_to_string(ws, ' ') AS content FROM c GROUP BY content),
n AS (SELECT pos, count(*) AS n FROM s JOIN firsts USING (pos) GROUP BY pos),
near AS (
  SELECT DISTINCT pos FROM (
    SELECT a.pos AS pos, b.pos AS other FROM s a JOIN n na ON na.pos = a.pos JOIN s b ON a.tok = b.tok JOIN n nb ON nb.pos = b.pos WHERE b.pos < a.pos
    GROUP BY a.pos, b.pos HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*)))),
gone AS (SELECT doc_id, line_no FROM c WHERE pos NOT IN (SELECT pos FROM firsts) OR pos IN (SELECT pos FROM near)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed, string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY l.line_no) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
