"""Query texts from templates, with every replacement made exactly once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(x: Column) -> Column:
    """``x`` with the marks of regular expressions escaped."""
    return F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def rendered(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by each value; null unless every placeholder stands exactly once."""
    out, once = template, F.lit(True)
    for name, value in values.items():
        once = once & (F.regexp_count(template, F.lit(rf"\{{{name}\}}")) == 1)
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(once, out)


def replaced_once(text: Column, pattern: str, value: Column) -> Column:
    """The only match of ``pattern`` replaced; null unless there is exactly one."""
    literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, F.lit(pattern), literal))
