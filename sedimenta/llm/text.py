"""Words as every operator of this subpackage counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space and the controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of ``text`` as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """``name`` as Spark reads it whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def set_aside(docs: DataFrame, **made: Column) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, with the columns ``made``; and the new name of each old one."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select("*", *made.values()).toDF(*names.values(), *made), names


def free_name(wish: str, taken: list[str]) -> str:
    """``wish``, with underscores before it until no column of ``taken`` has that name, whatever its case."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish = "_" + wish
    return wish
