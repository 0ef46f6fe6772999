"""Times as integer milliseconds since 1970, without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.units import HOUR_MS, MINUTE_MS, SECOND_MS


def millis(name: str) -> Column:
    """Milliseconds of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")


def _down(t: Column, unit: int) -> Column:
    return t - F.pmod(t, F.lit(unit).cast("long"))


def to_second(t: Column) -> Column:
    """Start of the second."""
    return _down(t, SECOND_MS)


def to_minute(t: Column) -> Column:
    """Start of the minute."""
    return _down(t, MINUTE_MS)


def to_hour(t: Column) -> Column:
    """Start of the hour."""
    return _down(t, HOUR_MS)


def next_hour(t: Column) -> Column:
    """Start of the next hour; an exact hour moves on by a full hour."""
    return to_hour(t) + HOUR_MS
