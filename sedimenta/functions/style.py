"""Features of source-like texts, as built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.text import blank, has, left_stripped, right_stripped


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def full_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~blank(x))


def _share(values: Column, pattern: str) -> Column:
    return F.size(F.filter(values, lambda x: x.rlike(pattern))) / F.greatest(F.size(values), F.lit(1))


def line_features(text: Column, *, lines: Column | None = None, full: Column | None = None) -> dict[str, Column]:
    """Line, indent, identifier, number and punctuation features of a whole text.

    ``lines`` and ``full`` (those that are not blank) may be given as columns of the table, which are worked out once.
    """
    lines = F.split(text, "\n") if lines is None else lines
    full = full_lines(lines) if full is None else full
    lengths = F.transform(lines, lambda x: F.length(right_stripped(x)))
    indents = F.transform(full, lambda x: F.length(x) - F.length(left_stripped(x)))
    names = F.regexp_count(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"))
    named = F.length(text) - F.length(F.regexp_replace(text, r"[A-Za-z_][A-Za-z0-9_]*", ""))
    n = F.greatest(F.size(full), F.lit(1))
    return {
        "log_lines": F.log1p(F.size(lines)),
        "line_len_mean": _mean(lengths),
        "line_len_p90": F.element_at(F.sort_array(lengths), F.floor(F.lit(0.9) * (F.size(lengths) - 1)).cast("int") + 1).cast("double"),
        "blank_rate": (F.size(lines) - F.size(full)) / F.size(lines),
        "indent_mean": _mean(indents),
        "trailing_ws_rate": _share(full, r"\s$"),
        "semicolon_rate": F.size(F.filter(full, lambda x: has(x, ";") & x.rlike(r";\s*$"))) / F.greatest(F.size(full), F.lit(1)),
        "ident_len_mean": F.when(names > 0, named / names).otherwise(0.0),
        "ident_long_rate": F.regexp_count(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{13,}")) / F.greatest(names, F.lit(1)),
        "number_rate": F.regexp_count(text, F.lit(r"\d+(?:\.\d+)?")) / n,
        "punct_rate": (F.length(text) - F.length(F.translate(text, "(){}[],.;:=", ""))) / F.greatest(F.length(text), F.lit(1)),
    }


# The patterns and language sets that define the style features.
HASH_LANGUAGES = ["Python", "Ruby", "Shell", "YAML"]
CURLY_LANGUAGES = ["TypeScript", "JavaScript", "Go", "Java", "C", "C++", "C#", "Rust", "Kotlin", "Swift", "Scala", "PHP", "Objective-C"]
COMMENT = {
    "explanatory_rate": r"(?i)\b(this (?:function|method|class|helper|module)|note that|we (?:need|want|must)|in order to|for clarity|as (?:a|an) (?:result|example)|ensures? that|handles? the case|this is (?:the|a)|which (?:means|allows))\b",
    "todo_rate": r"(?i)\b(TODO|FIXME|XXX|HACK|NOTE):",
    "emoji_comment_rate": r"[\x{1F300}-\x{1FAFF}✅✨❌⭐⚠]",
}
STEP = r"(?i)(?://|#)\s*(?:step\s*\d|\d[.)])\s"
CODE = {
    "guard_rate": r"\b(if\s*\(?\s*!|if\s+not\s|is None|== nil|!= nil|err\s*!=\s*nil|=== undefined|\?\?|catch\b|except\b|rescue\b)",
    "logging_rate": r"\b(console\.(log|error|warn|info)|print\(|printf\(|logger?\.(debug|info|warn|warning|error)|log\.(Printf|Println|Fatal))",
    "raise_rate": r"\b(raise|throw)\s",
    "typehint_rate": r"(?:\)\s*(?:->|:)\s*[A-Za-z_\[\{]|[a-z_][A-Za-z0-9_]*\s*:\s*[A-Z][A-Za-z0-9_\[\]<>|.]*)",
    "fstring_rate": r"(?:f\"|f'|`[^`]*\$\{)",
    "kwarg_rate": r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[^=]",
    "ternary_rate": r"\?[^?:\n]{1,40}:|(\bif\b.+\belse\b)",
    "async_rate": r"\b(await|async|\.then\(|go func|goroutine)\b",
}
#: Every match of a pattern holds one of these: lines without them are not searched.
NEEDED = {
    "guard_rate": ("if", "is None", "nil", "=== undefined", "??", "catch", "except", "rescue"),
    "logging_rate": ("console.", "print", "log"),
    "raise_rate": ("raise", "throw"),
    "typehint_rate": (":", "->"),
    "fstring_rate": ('f"', "f'", "`"),
    "kwarg_rate": ("=",),
    "ternary_rate": ("?", "else"),
    "async_rate": ("await", "async", ".then(", "go func", "goroutine"),
}
DIVIDER = r"(?://|#)\s*[-=*_#]{4,}"
ELISION = r"(?i)(?://|#)\s*\.\.\.\s*(existing|rest of|remaining|the rest|unchanged|other)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{1,}"
STRING = r"\"([^\"\\\n]|\\.)*\"|'([^'\\\n]|\\.)*'"
NUMBER = r"(?<![A-Za-z0-9_])\d+(\.\d+)?"
SNAKE = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
CAMEL = r"^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"


_rstrip, _lstrip = right_stripped, left_stripped


def _deviation(values: Column) -> Column:
    """Sample deviation of an array of whole numbers, 0 for fewer than two; one fold, its sums are exact."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    n = F.size(values)

    def spread(sums: Column) -> Column:
        s, q = sums["s"].cast("double"), sums["q"].cast("double")
        return F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) / (n - 1))

    folded = F.aggregate(values, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")), spread)
    return F.when(n > 1, folded).otherwise(0.0)


def _safe(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(0.0)


def split_comment(line: Column, prefixes: Column) -> Column:
    """Struct of ``code`` and ``comment``: a line that opens with a prefix, or from the first marker outside quotes."""
    bare = _lstrip(line)
    opening = F.element_at(F.filter(prefixes, lambda p: bare.startswith(p)), 1)
    odd = lambda head, q: (F.length(head) - F.length(F.replace(head, F.lit(q), F.lit("")))) % 2 == 1

    def place(mark: str) -> Column:
        at = F.instr(line, mark)
        head = F.substring(line, F.lit(1), at - 1)
        return F.when((at > 1) & ~odd(head, '"') & ~odd(head, "'"), at)

    best = F.least(place("//"), place("#"))
    inside = F.when(
        best.isNotNull(),
        F.struct(F.substring(line, F.lit(1), best - 1).alias("code"), F.regexp_replace(F.substring(line, best, F.length(line)), r"^[/# ]+", "").alias("comment")),
    ).otherwise(F.struct(line.alias("code"), F.lit("").alias("comment")))
    has_opening = F.size(F.filter(prefixes, lambda p: bare.startswith(p))) > 0
    after = F.when(has_opening, F.substring(bare, F.length(F.when(has_opening, opening)) + 1, F.length(bare))).otherwise("")
    # most lines have neither a marker inside nor a prefix before
    whole = F.struct(line.alias("code"), F.lit("").alias("comment"))
    return F.when(has_opening, F.struct(F.lit("").alias("code"), after.alias("comment"))).when(has(line, "//", "#"), inside).otherwise(whole)


def source_features(df, *, text: str, language: str):
    """``df`` with the 46 style features of a block of source lines.

    A null or empty text has all features 0.  Every feature is a built-in array
    expression over the lines, the code parts and the comments.
    """
    lang = F.col(language)
    prefixes = F.when(lang.isin(*HASH_LANGUAGES), F.array(F.lit("#"))).when(lang.isin(*CURLY_LANGUAGES), F.array(*[F.lit(x) for x in ("//", "/*", "*", "*/")])).otherwise(F.array(*[F.lit(x) for x in ("#", "//", "/*", "*")]))
    own = df.columns
    rows = df.withColumn("__pre", prefixes).withColumn("__l", F.when(F.coalesce(F.col(text), F.lit("")) != "", F.split(text, "\n")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__s", F.transform("__l", lambda x: split_comment(x, F.col("__pre"))))
    rows = rows.withColumns({
        "__k": F.transform(F.filter(F.transform("__s", lambda s: s["comment"]), lambda x: ~blank(x)), lambda x: _lstrip(_rstrip(x))),
        "__c": F.filter(F.transform("__s", lambda s: s["code"]), lambda x: ~blank(x)),
        "__f": F.filter("__l", lambda x: ~blank(x)),
        "__len": F.transform("__l", lambda x: F.length(_rstrip(x))),
        "__both": F.size(F.filter("__s", lambda s: ~blank(s["code"]) & ~blank(s["comment"]))),
        "__only": F.size(F.filter("__s", lambda s: blank(s["code"]) & ~blank(s["comment"]))),
    })
    rows = rows.withColumns({
        "__b": F.array_join("__c", "\n"),
        "__ind": F.transform("__f", lambda x: F.length(x) - F.length(_lstrip(x))),
        "__w": F.transform("__k", lambda x: F.regexp_count(x, F.lit(r"\S+"))),
    })
    rows = rows.withColumns({"__id": F.regexp_extract_all("__b", F.lit(IDENTIFIER), F.lit(0)), "__str": F.when(has(F.col("__b"), '"', "'"), F.regexp_extract_all("__b", F.lit(STRING), F.lit(0))).otherwise(F.array().cast("array<string>"))})
    n, nk, nf = F.size("__l"), F.size("__k"), F.greatest(F.size("__f"), F.lit(1))
    nc, ni = F.greatest(F.size("__c"), F.lit(1)), F.greatest(F.size("__id"), F.lit(1))
    some = lambda values, test: F.size(F.filter(values, test))
    having = lambda name, pattern: some("__c", lambda x: has(x, *NEEDED[name]) & x.rlike(pattern))
    quotes = lambda q: F.length("__b") - F.length(F.replace(F.col("__b"), F.lit(q), F.lit("")))
    out = {
        "log_lines": F.log1p(n),
        "line_len_mean": _mean(F.col("__len")),
        "line_len_sd": _deviation(F.col("__len")),
        "line_len_p90": F.when(n > 0, F.get(F.sort_array("__len"), F.floor(F.lit(0.9) * (n - 1)).cast("int"))).otherwise(0),
        "blank_rate": _safe(n - F.size("__f"), n),
        "indent_mean": _mean(F.col("__ind")),
        "indent_sd": _deviation(F.col("__ind")),
        "tab_rate": some("__f", lambda x: x.startswith("\t")) / nf,
        "trailing_ws_rate": some("__f", lambda x: x != _rstrip(x)) / nf,
        "comment_line_rate": _safe(F.col("__only"), n),
        "inline_comment_rate": F.col("__both") / nc,
        "comment_words_mean": _mean(F.col("__w")),
        "comment_capital_rate": _safe(some("__k", lambda x: x.rlike(r"^\p{Lu}")), nk),
        "comment_period_rate": _safe(some("__k", lambda x: x.rlike(r"\.$")), nk),
        "comment_long_rate": _safe(some("__w", lambda x: x >= 12), nk),
        "comment_per_code": nk / nc,
        "explanatory_rate": _safe(some("__k", lambda x: x.rlike(COMMENT["explanatory_rate"])), nk),
        "step_comment_rate": _safe(some("__k", lambda x: F.concat(F.lit("# "), x).rlike(STEP)), nk),
        "todo_rate": _safe(some("__k", lambda x: x.rlike(COMMENT["todo_rate"])), nk),
        "emoji_comment_rate": _safe(some("__k", lambda x: x.rlike(COMMENT["emoji_comment_rate"])), nk),
        "docstring_present": F.coalesce(F.col(text).contains('"""') | F.col(text).contains("'''") | F.col(text).contains("/**"), F.lit(False)).cast("double"),
        "divider_rate": _safe(some("__l", lambda x: has(x, "//", "#") & x.rlike(DIVIDER)), n),
        "elision_present": F.coalesce(has(F.col(text), "...") & F.col(text).rlike(ELISION), F.lit(False)).cast("double"),
        **{name: having(name, pattern) / nc for name, pattern in CODE.items()},
        "semicolon_rate": some("__c", lambda x: has(x, ";") & x.rlike(r";\s*$")) / nc,
        "brace_only_rate": some("__c", lambda x: has(x, "{", "}") & _lstrip(_rstrip(x)).isin("{", "}", "});", "};")) / nc,
        "ident_len_mean": _mean(F.transform("__id", F.length)),
        "ident_long_rate": some("__id", lambda x: F.length(x) >= 14) / ni,
        "snake_rate": some("__id", lambda x: has(x, "_") & x.rlike(SNAKE)) / ni,
        "camel_rate": some("__id", lambda x: x.rlike(CAMEL)) / ni,
        "string_rate": F.size("__str") / nc,
        "string_len_mean": _mean(F.transform("__str", lambda x: F.length(x) - 2)),
        "number_rate": F.regexp_count("__b", F.lit(NUMBER)) / nc,
        "punct_rate": (F.length("__b") - F.length(F.translate("__b", "(){}[],.;:=", ""))) / F.greatest(F.length("__b"), F.lit(1)),
        "double_quote_pref": quotes('"') / F.greatest(quotes('"') + quotes("'"), F.lit(1)),
        "is_python": (lang == "Python").cast("double"),
        "is_ts_js": lang.isin("TypeScript", "JavaScript").cast("double"),
        "is_go": (lang == "Go").cast("double"),
        "is_curly_other": lang.isin(*[x for x in CURLY_LANGUAGES if x not in ("TypeScript", "JavaScript", "Go")]).cast("double"),
    }
    return rows.select(*own, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in out.items()])
