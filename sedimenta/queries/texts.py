"""Text: message style, first reasons, canonical URLs, digests, and source-style features of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import messages as M
from sedimenta.functions import paths as A
from sedimenta.functions import style as Y
from sedimenta.functions import text as T
from sedimenta.functions.hashing import nul_digest
from sedimenta.plans.scratch import materialize
from sedimenta.queries import query, r6, table


@query(
    r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS words, len(string_split(text, chr(10))) AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*+]|\d+[.)])\s+\S'))) AS bullets, len(regexp_extract_all(text, '\b[A-Z][a-z]+')) AS capitals,
  len(regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?](?:\s|$)')) AS sentences, sha256(text) AS digest FROM conversations"""
)
def message_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = T.style(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[style[c].alias(c) for c in ("words", "lines", "bullets", "capitals", "sentences", "digest")])


@query(
    """WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' AS full_line FROM l), b AS (SELECT *, coalesce(lag(full_line) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM f)
SELECT doc_id, CAST(count(*) FILTER (full_line AND NOT before) AS INTEGER) AS paragraphs FROM b GROUP BY doc_id""".replace("\\\\", "\\")
)
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))


@query(
    r"""SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '/+$', ''), '\.git$', ''), '^(?i:https?://)?(?i:github\.com/)?', '')) AS repository,
  CASE WHEN len(string_split(regexp_replace(url, '/+$', ''), '/')) >= 2 THEN array_to_string(string_split(regexp_replace(url, '/+$', ''), '/')[-2:], '/') END AS name FROM pages"""
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_repository(F.col("url")).alias("repository"), T.repository_name(F.col("url")).alias("name"))


PATTERNS = {"apache": [r"Apache License", r"apache\.org"], "gpl": [r"GNU General Public"], "mit": [r"MIT License"], "contact": [r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+"]}


@query(
    r"""WITH h AS (SELECT doc_id, regexp_matches(text, 'Apache License|apache\.org') AS a, regexp_matches(text, 'GNU General Public') AS g, regexp_matches(text, 'MIT License') AS m, regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+') AS c, length(text) > 5000 AS l FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'apache' END, CASE WHEN g THEN 'gpl' END, CASE WHEN m THEN 'mit' END, CASE WHEN c THEN 'contact' END) AS labels, a::INT + g::INT + m::INT + c::INT + l::INT AS score,
  CASE WHEN c THEN 'personal' WHEN l THEN 'long' WHEN NOT (a OR g OR m) THEN 'no_licence' END AS reason FROM h"""
)
def message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    labels = T.labels_matching(text, PATTERNS)
    has = {n: F.array_contains(labels, n) for n in PATTERNS}
    long = F.length(text) > 5000
    score, _ = T.signal_score({**has, "long": long})
    reason = T.first_reason((has["contact"], "personal"), (long, "long"), (~(has["apache"] | has["gpl"] | has["mit"]), "no_licence"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(labels, ",").alias("labels"), score.alias("score"), reason.alias("reason"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_orderkey || chr(0) || l_linenumber || chr(0) || l_partkey || chr(0) || l_returnflag) AS line_id FROM lineitem")
def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nul_digest(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag")).alias("line_id"))


_L = "string_split(text, chr(10))"


@query(
    rf"""WITH l AS (SELECT doc_id, text, {_L} AS ls FROM documents), n AS (SELECT *, list_filter(ls, lambda x: regexp_replace(x, '\s+', '', 'g') <> '') AS nb, list_transform(ls, lambda x: length(regexp_replace(x, '\s+$', ''))) AS lens FROM l),
i AS (SELECT *, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS ids FROM n)
SELECT doc_id, round(ln(1 + len(ls)), 6) AS log_lines, round(list_avg(lens), 6) AS line_len_mean, CAST(list_sort(lens)[CAST(floor(0.9 * (len(lens) - 1)) AS INTEGER) + 1] AS DOUBLE) AS line_len_p90,
  round((len(ls) - len(nb)) / len(ls), 6) AS blank_rate, round(coalesce(list_avg(list_transform(nb, lambda x: length(x) - length(regexp_replace(x, '^\s+', '')))), 0), 6) AS indent_mean,
  round(len(list_filter(nb, lambda x: regexp_matches(x, '\s$'))) / greatest(len(nb), 1), 6) AS trailing_ws_rate, round(len(list_filter(nb, lambda x: regexp_matches(x, ';\s*$'))) / greatest(len(nb), 1), 6) AS semicolon_rate,
  round(coalesce(list_avg(list_transform(ids, lambda x: length(x))), 0), 6) AS ident_len_mean, round(len(list_filter(ids, lambda x: length(x) >= 14)) / greatest(len(ids), 1), 6) AS ident_long_rate,
  round(len(regexp_extract_all(text, '\d+(?:\.\d+)?')) / greatest(len(nb), 1), 6) AS number_rate, round((length(text) - length(translate(text, '(){{}}[],.;:=', ''))) / greatest(length(text), 1), 6) AS punct_rate FROM i"""
)
def source_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines")).withColumn("full", Y.full_lines(F.col("lines")))
    features = Y.line_features(F.col("text"), lines=F.col("lines"), full=F.col("full"))
    return docs.select("doc_id", *[r6(features[c]).alias(c) for c in features])


@query(
    r"""WITH u AS (SELECT page_id, url, lower(url) AS low, '/' || lower(url) AS rooted, string_split(lower(url), '/')[-1] AS name FROM pages)
SELECT page_id, lower(regexp_extract(url, '(\.[^.]*)$', 1)) AS extension, CASE WHEN contains(rooted, '/test/') OR contains(rooted, '/tests/') OR starts_with(name, 'test_') OR ends_with(name, '_test.go') OR ends_with(name, '_test.py') THEN 'test' ELSE 'production' END AS kind,
  CASE WHEN ends_with(low, '.md') OR ends_with(low, '.rst') OR starts_with(name, 'readme') OR starts_with(name, 'changelog') THEN 'documentation'
    WHEN contains(rooted, '/test') OR contains(rooted || '/', '/tests/') OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR ends_with(name, '_test.go') THEN 'test' ELSE 'source' END AS path_class FROM u"""
)
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", A.extension(url).alias("extension"), A.code_kind(url).alias("kind"), A.path_class(url).alias("path_class"))


MESSAGES = r"""x AS (SELECT doc_id, source, replace(text, chr(13) || chr(10), chr(10)) AS m FROM documents),
x1 AS (SELECT doc_id, source, regexp_replace(m, '(?im)^(?:co-authored-by|coauthored-by|generated-by|assisted-by|ai-generated-by|ai-assisted-by|signed-off-by):[^\n]*(?:\n|$)', '', 'g') AS m FROM x),
x2 AS (SELECT doc_id, source, regexp_replace(m, '(?i)\b(?:claude(?:\s+(?:code|opus|sonnet|haiku))?|chatgpt|codex|github\s+copilot|copilot|cursor|devin|gemini|openai|anthropic)\b', '', 'g') AS m FROM x1),
x3 AS (SELECT doc_id, source, regexp_replace(regexp_replace(m, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '', 'g'), 'https?://\S+', '', 'g') AS m FROM x2),
x4 AS (SELECT doc_id, source, regexp_replace(regexp_replace(m, '(^|[^\p{L}\p{N}_])@[A-Za-z0-9_-]+', '\1', 'g'), '(^|[^\p{L}\p{N}_])#\d+\b', '\1', 'g') AS m FROM x3),
x5 AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(m, '(?i)(^|[^\p{L}\p{N}_])[0-9a-f]{7,40}([^\p{L}\p{N}_]|$)', '\1\2', 'g'), '(?i)(^|[^\p{L}\p{N}_])[0-9a-f]{7,40}([^\p{L}\p{N}_]|$)', '\1\2', 'g'), '(?m)[^\S\n]+$', '', 'g') AS m FROM x4),
x6 AS (SELECT doc_id, source, regexp_replace(regexp_replace(m, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS m FROM x5),
b AS (SELECT doc_id, source, m, regexp_replace(m, '^[^\n]*\n*', '') AS b FROM x6),
l AS (SELECT *, list_filter(string_split(b, chr(10)), lambda z: regexp_matches(z, '\S')) AS ls FROM b),
p AS (SELECT *, list_filter(ls, lambda z: NOT regexp_matches(z, '^\s*(?:[-*+]|\d+[.)])\s+\S')) AS prose FROM l),
f AS (SELECT doc_id, source, m, len(regexp_extract_all(b, '[\p{L}\p{N}_''-]*[\p{L}\p{N}_][\p{L}\p{N}_''-]*')) AS body_words, len(ls) AS body_lines, len(ls) - len(prose) AS bullets, len(regexp_extract_all(b, '[.!?]["'')\]]*(?:\s|$)')) AS sentences,
  len(list_filter(string_split(b, chr(10) || chr(10)), lambda z: regexp_matches(z, '\S'))) AS parts, CASE WHEN len(prose) > 0 THEN len(list_filter(prose, lambda z: regexp_matches(z, '[.!?]["'')\]]*\s*$'))) / len(prose) ELSE 0 END AS rate,
  regexp_matches(b, '(?i)\b(?:(?:ran|run|running|passes?|passed|passing|green|verified?|validated?)(?:\s+\w+){0,5}\s+(?:tests?|checks?|pytest|go\s+test|cargo\s+test|lint(?:er|ing)?|type[- ]?checks?|build)|(?:tests?|checks?|pytest|go\s+test|cargo\s+test|lint(?:er|ing)?|type[- ]?checks?|build)(?:\s+\w+){0,5}\s+(?:ran|run|passes?|passed|passing|green|succeeded|completed|verified?))\b') AS validation FROM p),
q AS (SELECT source, count(*) AS n, list_sort(list(body_words)) AS w, list_sort(list(parts + bullets + sentences)) AS s FROM f WHERE m <> '' GROUP BY source),
g AS (SELECT f.*, CASE WHEN n >= 30 THEN w[CAST(ceil(0.9 * n) AS INTEGER)] END AS w90, CASE WHEN n >= 30 THEN s[CAST(ceil(0.9 * n) AS INTEGER)] END AS s90 FROM f LEFT JOIN q ON f.source = q.source),
h AS (SELECT *, list_filter([CASE WHEN body_words >= 80 THEN 'verbose_body' END, CASE WHEN body_lines >= 4 AND parts >= 2 THEN 'structured_body' END, CASE WHEN bullets >= 3 THEN 'enumerated_detail' END, CASE WHEN sentences >= 4 AND rate >= 0.5 THEN 'sentence_form' END,
  CASE WHEN validation THEN 'explicit_validation' END, CASE WHEN body_words > w90 THEN 'local_length_outlier' END, CASE WHEN parts + bullets + sentences > s90 THEN 'local_structure_outlier' END], lambda z: z IS NOT NULL) AS sig FROM g)"""


@query(
    f"""WITH {MESSAGES} SELECT doc_id, sha256(m) AS message_sha256, body_words, body_lines, bullets, sentences, CASE WHEN m IS NOT NULL THEN len(sig) ELSE 0 END AS score, array_to_string(sig, ',') AS signals, len(sig) >= 3 AS at_3, len(sig) >= 4 AS at_4, len(sig) >= 5 AS at_5 FROM h"""
)
def message_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point score of every document read as a message, with the baselines of its source."""
    # written once, as the texts would be read again for the baselines
    docs = materialize(M.with_style(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text").drop("text"))
    scored = M.classified(docs.join(M.baselines(docs, by="source"), "source", "left"))
    return scored.select("doc_id", "message_sha256", "body_words", "body_lines", "bullets", "sentences", "score", F.array_join("signals", ",").alias("signals"), "at_3", "at_4", "at_5")


@query()
def style_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 46 style features of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return Y.source_features(docs, text="text", language="lang").drop("text", "lang")
