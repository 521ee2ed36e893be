"""Time arithmetic on zone-less timestamps (session time zone: UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return (to_micros(end) - to_micros(start)) / F.lit(1e6)


def minus_seconds(ts: Column, seconds: Column) -> Column:
    return from_micros(to_micros(ts) - F.bround(seconds * 1e6).cast("bigint"))


def floor_to(ts: Column, unit: str) -> Column:
    """Start of the hour, minute or day that holds ``ts``."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def floor_div(value: Column, step: int) -> Column:
    """Integer quotient rounded down, exact for any 64-bit value."""
    return ((value - F.pmod(value, F.lit(step))) / F.lit(step)).cast("bigint")


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:00")


def parse_iso(text: Column) -> Column:
    """Log time: the zone suffix is stripped, the wall clock is kept."""
    bare = F.regexp_replace(F.trim(text), r"Z*([+-]\d{2}:\d{2})?$", "")
    return F.coalesce(
        bare.try_cast("timestamp_ntz"), F.substring(bare, 1, 19).try_cast("timestamp_ntz")
    )


def zone_offset(text: Column) -> Column:
    """Seconds that the zone suffix of a log time is ahead of UTC; 0 without one."""
    zone = F.regexp_extract(text, r"([+-]\d{2}:\d{2})\s*$", 1)
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    return F.coalesce(sign * (hours * 3600 + minutes * 60), F.lit(0))


def parse_epoch_ms(text: Column, zone: str | Column = "UTC") -> Column:
    """Epoch milliseconds, as a number or text; 0 and unreadable give NULL.

    ``zone`` is a zone name, or a column of seconds ahead of UTC.
    """
    ms = F.nullif(text.try_cast("bigint"), F.lit(0))
    if isinstance(zone, Column):
        return F.timestamp_millis(ms + zone * 1000).cast("timestamp_ntz")
    utc = F.timestamp_millis(ms)
    if zone != "UTC":
        utc = F.from_utc_timestamp(utc, zone)
    return utc.cast("timestamp_ntz")
