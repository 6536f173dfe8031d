"""Digests and the deterministic draws made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nul_digest(*parts: Column) -> Column:
    """SHA-256 in hex of the parts joined by NUL; a null part makes the digest null."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), p.cast("string"))
    return F.sha2(joined.cast("binary"), 256)


def digest_modulo(digest: Column, k: int) -> Column:
    """The whole 256-bit number of a hex digest modulo ``k``, by Horner's rule over its digits."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.lit(0).cast("long"),
        lambda rest, i: (rest * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long")) % k,
    )


def digest_head(digest: Column) -> Column:
    """The first 64 bits of a hex digest as decimal(20, 0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def drawn(digest: Column, basis_points: int) -> Column:
    """True for about ``basis_points`` of 10,000 digests, always the same ones."""
    return (digest_head(digest) % 10000).cast("int") < basis_points
