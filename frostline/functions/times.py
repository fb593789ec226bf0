"""Event-time helpers. Event time is BIGINT microseconds since the epoch inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.config import MICROS


def epoch_micros(seconds: Column) -> Column:
    """DOUBLE epoch seconds to BIGINT microseconds, null if they do not fit."""
    return F.round(seconds * F.lit(float(MICROS))).try_cast("bigint")


def micros_to_seconds(micros: Column) -> Column:
    return micros / F.lit(float(MICROS))


def window_floor(micros: Column, size_us: int) -> Column:
    """Start of the epoch-aligned tumbling window [start, start + size) that holds the instant."""
    return micros - micros % F.lit(size_us)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 time, `Z` or an offset at its end or else UTC; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(text))


def seconds_between(start_us: Column, end_us: Column) -> Column:
    """Whole seconds from one time to another, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.call_function("div", end_us - start_us, F.lit(1_000_000)))
