"""Intervals cut at clock hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.times import floor_to, seconds_between


def slice_hours(intervals: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """One row per hour an interval touches, with ``hour``, ``slice_s``, ``frac``.

    ``slice_s`` is the time inside the hour and ``frac`` its share of the
    interval. Slices without length are dropped, except that of an interval that
    has no length itself (its ``frac`` is NULL).
    """
    one_hour = F.expr("INTERVAL 1 HOUR")
    first, last = floor_to(F.col(start), "HOUR"), floor_to(F.col(end), "HOUR")
    whole = seconds_between(F.col(start), F.col(end))
    return (
        intervals.withColumn("hour", F.explode(F.sequence(first, last, one_hour)))
        .withColumn(
            "slice_s",
            seconds_between(
                F.greatest(F.col(start), F.col("hour")),
                F.least(F.col(end), F.col("hour") + one_hour),
            ),
        )
        .where((F.col("slice_s") > 0) | (whole == 0))
        .withColumn("frac", F.try_divide(F.col("slice_s"), whole))
    )


def occupied_seconds(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Occupied seconds per ``keys`` and hour, at most one hour per cell."""
    return (
        slice_hours(intervals)
        .groupBy(*keys, "hour")
        .agg(F.least(F.sum("slice_s"), F.lit(S.HOUR_S)).alias("occupied_s"))
    )
