"""Canonical JSON, hashes and hash splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import col


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; nulls are written out."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_address(fields: Column) -> Column:
    """Compact JSON of a map with its keys sorted: two addresses are equal if these texts are."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def hash_bucket(hex_digest: Column | str, modulus: int = 100) -> Column:
    """First eight hex digits as an integer, modulo ``modulus``."""
    return F.conv(F.substring(col(hex_digest), 1, 8), 16, 10).cast("bigint") % modulus


def hash_split(hex_digest: Column | str) -> Column:
    """80/10/10 split by hash bucket."""
    b = hash_bucket(hex_digest)
    return F.when(b < 80, "train").when(b < 90, "dev").otherwise("held_out")


def short_sha1(*parts: Column, digits: int) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, digits)


def value_text(c: Column | str, kind: str = "string") -> Column:
    """Text rendering used for evidence values."""
    if kind == "boolean":
        return F.when(col(c), "true").when(~col(c), "false").otherwise("null")
    return F.coalesce(col(c).cast("string"), F.lit("null"))
