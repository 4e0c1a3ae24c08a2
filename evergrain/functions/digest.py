"""Digests, durations, dates and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 24 * 3600 * 1000


def domain_hash(domain: str, body: Column) -> Column:
    """SHA-256 over a domain, a zero byte and a body."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), body.cast("binary")), 256)


def identity(prefix: str, *fields: Column) -> Column:
    """A prefixed digest of fields, length-framed so that no two lists of fields agree by chance."""
    framed = [F.concat(F.octet_length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat(*framed), 256))


def blob_id(data: Column) -> Column:
    """The git object id of bytes as a blob."""
    raw = data.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.lit(b"\0"), raw))


def milliseconds(value: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """(ms, invalid): NaN, infinite, negative or over a day is invalid and null; missing is null and not invalid."""
    v = value.cast("double") * scale
    bad = value.isNotNull() & (F.isnan(v) | (v < 0) | (v > DAY_MS))
    return F.when(~bad, F.round(v)).cast("long"), bad


def canonical_sequence(s: Column) -> Column:
    """Whether a text is an unsigned decimal number without leading zeros."""
    return s.rlike("^(0|[1-9][0-9]*)$")


def age_state(age_days: Column, fresh: int, stale: int) -> Column:
    return F.when(age_days.isNull(), "unknown").when(age_days <= fresh, "current").when(age_days <= stale, "stale").otherwise("retired")


def empty_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))
