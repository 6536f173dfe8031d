"""Commit messages: provenance removed, style counted, points given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.text import has, has_anycase, once, paragraphs, signal_score

# What normalization removes, in order, the marks of style, and the limits of the signals.
REMOVED = [
    r"(?imU)^(?:co-authored-by|coauthored-by|generated-by|assisted-by|ai-generated-by|ai-assisted-by|signed-off-by):[^\n]*(?:\n|$)",
    r"(?iU)\b(?:claude(?:\s+(?:code|opus|sonnet|haiku))?|chatgpt|codex|github\s+copilot|copilot|cursor|devin|gemini|openai|anthropic)\b",
    r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?U)https?://\S+",
    r"(?U)(?<!\w)@[A-Za-z0-9_-]+",
    r"(?U)(?<!\w)#\d+\b",
    r"(?iU)\b[0-9a-f]{7,40}\b",
]
#: What a text must hold for each of them to match, in small letters where case does not matter; none where there is no such part.
NEEDED = [
    (),
    ("claude", "chatgpt", "codex", "copilot", "cursor", "devin", "gemini", "openai", "anthropic"),
    ("@",), ("://",), ("@",), ("#",), (),
]
WORD = r"(?U)\b[\w'-]+\b"
BULLET = r"(?U)^\s*(?:[-*+]|\d+[.)])\s+\S"
SENTENCE = r"(?U)[.!?](?=(?:[\"')\]]*)?(?:\s|$))"
CLOSED = r"(?U)[.!?][\"')\]]*\s*$"
VALIDATION = (
    r"(?iU)\b(?:(?:ran|run|running|passes?|passed|passing|green|verified?|validated?)(?:\s+\w+){0,5}\s+(?:tests?|checks?|pytest|go\s+test|cargo\s+test|lint(?:er|ing)?|type[- ]?checks?|build)"
    r"|(?:tests?|checks?|pytest|go\s+test|cargo\s+test|lint(?:er|ing)?|type[- ]?checks?|build)(?:\s+\w+){0,5}\s+(?:ran|run|passes?|passed|passing|green|succeeded|completed|verified?))\b"
)
VALIDATED = ("test", "check", "lint", "build")
VERBOSE_WORDS, BODY_LINES, BODY_PARAGRAPHS, BULLETS, SENTENCES, SENTENCE_LINES = 80, 4, 2, 3, 4, 0.5
LEAST_MESSAGES, QUANTILE = 30, 0.9
#: What ends a line besides the line feed.
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def _without(pattern: str, parts: tuple[str, ...]) -> Callable[[Column], Column]:
    asked = has_anycase if pattern.startswith("(?i") else has
    return lambda x: F.when(asked(x, *parts), F.regexp_replace(x, pattern, "")).otherwise(x) if parts else F.regexp_replace(x, pattern, "")


def normalized(message: Column) -> Column:
    """Without direct provenance marks, lines right-trimmed, runs of blank lines as one, outer white space off."""
    out = F.replace(message, F.lit("\r\n"), F.lit("\n"))
    for pattern, parts in zip(REMOVED, NEEDED, strict=True):
        out = once(out, _without(pattern, parts))
    out = F.regexp_replace(out, LINE_ENDS, "\n")
    out = F.regexp_replace(out, r"(?mdU)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def with_style(df: DataFrame, message: str) -> DataFrame:
    """Adds the digest and subject words of a normalized message and the counts of its body, which is all but the first line."""
    rows = df.withColumn("__m", normalized(F.col(message)))
    rows = rows.withColumn("__b", F.regexp_replace("__m", r"^[^\n]*\n*", ""))
    full = lambda x: x.rlike(r"(?U)\S")
    lines = F.filter(F.split("__b", "\n"), full)
    prose = F.filter(lines, lambda x: ~x.rlike(BULLET))
    bullets, sentences, parts = F.size(lines) - F.size(prose), F.regexp_count("__b", F.lit(SENTENCE)), paragraphs(F.col("__b"))
    out = rows.withColumns({
        "message_sha256": F.sha2(F.col("__m").cast("binary"), 256),
        "empty_message": F.col("__m") == "",
        "subject_words": F.regexp_count(F.regexp_extract("__m", r"^[^\n]*", 0), F.lit(WORD)),
        "body_words": F.regexp_count("__b", F.lit(WORD)),
        "body_lines": F.size(lines),
        "body_paragraphs": parts,
        "bullets": bullets,
        "sentences": sentences,
        "sentence_line_rate": F.when(F.size(prose) > 0, F.size(F.filter(prose, lambda x: x.rlike(CLOSED))) / F.size(prose)).otherwise(0.0),
        "structure": parts + bullets + sentences,
        "validation": has_anycase(F.col("__b"), *VALIDATED) & F.col("__b").rlike(VALIDATION),
    })
    return out.drop("__m", "__b")


def baselines(df: DataFrame, *, by: str, least: int = LEAST_MESSAGES) -> DataFrame:
    """Nearest-rank 90th percentiles of body words and structure by repository, over messages that are not empty; null with fewer than ``least``.

    Values are counted first, so the windows hold one row a distinct value.
    """
    rows = df.filter(~F.col("empty_message"))
    n = rows.groupBy(by).agg(F.count("*").alias("messages"))
    at = F.greatest(F.lit(1), F.ceil(F.lit(QUANTILE) * F.col("messages")))
    out = n
    for value, name in (("body_words", "words_p90"), ("structure", "structure_p90")):
        counts = rows.groupBy(by, value).agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(by).orderBy(value))).withColumnRenamed(by, "__by")
        ranked = n.join(upto, F.col(by).eqNullSafe(F.col("__by"))).filter(F.col("upto") >= at).groupBy("__by").agg(F.min(value).alias(name))
        out = out.join(ranked, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return out.select(by, "messages", *[F.when(F.col("messages") >= least, F.col(c)).alias(c) for c in ("words_p90", "structure_p90")])


def classified(df: DataFrame, thresholds: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Adds ``score``, ``signals`` and ``at_<threshold>``; baselines of the repository are used where not null."""
    signals = {
        "verbose_body": F.col("body_words") >= VERBOSE_WORDS,
        "structured_body": (F.col("body_lines") >= BODY_LINES) & (F.col("body_paragraphs") >= BODY_PARAGRAPHS),
        "enumerated_detail": F.col("bullets") >= BULLETS,
        "sentence_form": (F.col("sentences") >= SENTENCES) & (F.col("sentence_line_rate") >= SENTENCE_LINES),
        "explicit_validation": F.col("validation"),
        "local_length_outlier": F.col("body_words") > F.col("words_p90"),
        "local_structure_outlier": F.col("structure") > F.col("structure_p90"),
    }
    score, names = signal_score(signals)
    return df.withColumns({"score": score, "signals": names}).withColumns({f"at_{t}": F.col("score") >= t for t in thresholds})
