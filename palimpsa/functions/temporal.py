"""Half-open interval predicates; a null start is unknown, a null end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_at(recorded: Column, superseded: Column, at: Column | None) -> Column:
    """System time: current rows without an instant, else rows whose interval holds it."""
    if at is None:
        return superseded.isNull()
    return (recorded <= at) & (superseded.isNull() | (superseded > at))


def valid_at(start: Column, end: Column, at: Column | None, include_unknown: bool = True) -> Column:
    """Business time; without an instant every row passes. An unknown start may pass, an end always counts."""
    if at is None:
        return F.lit(True)
    begun = (start <= at) | (F.lit(include_unknown) & start.isNull())
    return F.coalesce(begun, F.lit(False)) & (end.isNull() | (end > at))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """True overlap; intervals that only touch do not."""
    before = F.coalesce(start_a < end_b, F.lit(True))
    return before & F.coalesce(start_b < end_a, F.lit(True))


def temporal_status(start: Column, end: Column, at: Column) -> Column:
    """conflict (reversed), expired, not_yet_effective, effective or unknown."""
    return (
        F.when(start >= end, "conflict")
        .when(end <= at, "expired")
        .when(start > at, "not_yet_effective")
        .when(start.isNotNull(), "effective")
        .otherwise("unknown")
    )


def iso_instant(text: Column) -> Column:
    """Instant of ISO text with a zone, or of a bare date (midnight UTC); other text gives null."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)$")
    date = text.rlike(r"^\d{4}-\d\d-\d\d$")
    return F.when(zoned, F.try_to_timestamp(text)).when(date, F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
