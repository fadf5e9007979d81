"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bigint_id(key: Column) -> Column:
    """The first seven bytes of the MD5 of a string key as a number; never negative."""
    return F.conv(F.substring(F.md5(key), 1, 14), 16, 10).cast("long")


def joined_key(*parts: Column) -> Column:
    """Parts joined by '_'; null parts count as empty."""
    return F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and twelve hex digits of the MD5 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat(*(F.coalesce(p, F.lit("")) for p in parts))), 1, 12))


def members_key(member: Column) -> Column:
    """A key of a group from its members in any order (an aggregate that Spark merges): smallest, count, combined hashes."""
    return joined_key(F.min(member), F.count(member), F.bit_xor(bigint_id(member.cast("string"))))
