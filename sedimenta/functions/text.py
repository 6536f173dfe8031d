"""Text helpers whose edges differ between engines if left to defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``\s`` matches without the flag ``U``.
SPACE = " \t\n\x0b\x0c\r"
#: Line ends before which ``$`` matches although they are not white space there.
LATE_ENDS = ("\u0085", "\u2028", "\u2029")
#: What a pattern without regard to case takes for ``s``, ``i`` or ``k`` although its small letter is another one.
ODD_CASE = ("\u017f", "\u0131", "\u0130", "\u212a")


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, with ``x`` worked out once however often ``of`` names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def left_stripped(x: Column) -> Column:
    """``regexp_replace(x, "^\\s+", "")``, without a pattern."""
    return F.ltrim(x, F.lit(SPACE))


def right_stripped(x: Column) -> Column:
    """``regexp_replace(x, "\\s+$", "")``, with a pattern only where the text ends with one of ``LATE_ENDS``."""
    return F.when(any_of(x.endswith(e) for e in LATE_ENDS), F.regexp_replace(x, r"\s+$", "")).otherwise(F.rtrim(x, F.lit(SPACE)))


def blank(x: Column) -> Column:
    """Nothing but white space."""
    return F.btrim(x, F.lit(SPACE)) == ""


def any_of(tests) -> Column:
    """Whether one of the tests holds; later ones are not asked once one does."""
    first, *rest = tests
    for test in rest:
        first = first | test
    return first


def has(x: Column, *parts: str) -> Column:
    """Whether ``x`` holds one of ``parts``; asked before a pattern that needs one of them, it saves most of the work."""
    return any_of(F.contains(x, F.lit(part)) for part in parts)


def has_anycase(x: Column, *parts: str) -> Column:
    """The same for a pattern without regard to case; ``parts`` are in small letters."""
    return once(F.lower(x), lambda low: has(low, *parts)) | has(x, *ODD_CASE)


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def canonical_repository(url: Column) -> Column:
    """``host/owner/name`` URLs in one lower-case form, without scheme, ``.git`` and end slash."""
    bare = F.regexp_replace(strip(url), r"/+$", "")
    bare = F.regexp_replace(bare, r"\.git$", "")
    return F.lower(F.regexp_replace(bare, r"^(?i:https?://)?(?i:github\.com/)?", ""))


def repository_name(url: Column) -> Column:
    """The last two segments of a URL."""
    parts = F.split(F.regexp_replace(strip(url), r"/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))


def paragraphs(text: Column) -> Column:
    """Number of runs of non-blank lines."""
    empty = F.transform(F.split(text, "\n"), lambda x: blank(x).cast("int"))
    return F.aggregate(
        empty,
        F.struct(F.lit(0).alias("n"), F.lit(1).alias("before")),
        lambda a, b: F.struct((a["n"] + F.when((b == 0) & (a["before"] == 1), 1).otherwise(0)).alias("n"), b.alias("before")),
        lambda a: a["n"],
    )


def style(text: Column) -> dict[str, Column]:
    """Counts and rates of a message: words, lines, paragraphs, bullets, sentences, capitals, code marks."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: strip(x) != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S")))
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9']+"))
    n = F.size(full)
    return {
        "words": words,
        "lines": n,
        "paragraphs": paragraphs(text),
        "bullets": bullets,
        "bullet_rate": F.coalesce(F.try_divide(bullets, n), F.lit(0.0)),
        "sentences": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")),
        "capitals": F.regexp_count(text, F.lit(r"\b[A-Z][a-z]+")),
        "words_per_line": F.coalesce(F.try_divide(words, n), F.lit(0.0)),
        "digest": F.sha2(text.cast("binary"), 256),
    }


def signal_score(signals: dict[str, Column]) -> tuple[Column, Column]:
    """``(score, names)``: how many boolean signals hold, and which, in order."""
    held = [F.coalesce(v, F.lit(False)) for v in signals.values()]
    score = sum((h.cast("int") for h in held[1:]), held[0].cast("int"))
    names = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in zip(signals, held, strict=True)]))
    return score, names


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, in order, else null."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])


def labels_matching(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Names, in order, of the pattern lists of which any pattern occurs in ``text``."""
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in patterns.items()]))
