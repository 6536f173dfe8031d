"""Identities of people, and digests of records in one canonical form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.hashing import nul_digest
from sedimenta.functions.text import strip


def folded(x: Column) -> Column:
    """NFKC form with case folded; SQL has neither, so this is an Arrow UDF unless the text is ASCII."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return F.when(x.rlike(r"[^\x00-\x7F]"), fold(x)).otherwise(F.lower(x))


def author_name(name: Column) -> Column:
    """Folded, runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(folded(name), r"(?U)\s+", " "))


def author_email(email: Column) -> Column:
    """Folded, without white space."""
    return F.regexp_replace(folded(email), r"(?U)\s+", "")


def identity_hash(repository: Column, name: Column, email: Column) -> Column:
    """Digest of a person inside a repository: the three parts folded, the last two stripped, joined by NUL."""
    return nul_digest(F.lower(repository), F.lower(strip(name)), F.lower(strip(email)))


def utc_instant(at: Column) -> Column:
    """An instant as ISO-8601 text in UTC with ``Z``."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with the keys in order; nulls stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_digest(exclude: tuple[str, ...] = (), **fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the fields but the excluded ones, such as the digest's own."""
    return F.sha2(canonical_json(**{k: v for k, v in fields.items() if k not in exclude}).cast("binary"), 256)
