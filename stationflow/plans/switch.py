"""Robot switch time: release until the next arrival at the station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.times import floor_to
from stationflow.operators.grid import complete_grid, day_start, ticks
from stationflow.operators.pairing import switch_pairs
from stationflow.operators.quantiles import exact_quantiles
from stationflow.plans.throughput import CELL
from stationflow.tables import Tables


def switch_intervals(t: Tables) -> DataFrame:
    """Switch rows of all robots in [0, 7200) s, by release hour."""
    s = F.col("seconds")
    return (
        switch_pairs(t.located())
        .where((s >= 0) & (s < S.SWITCH_MAX_S))
        .select(
            "op_day",
            "station",
            floor_to(F.col("start_ts"), "HOUR").alias("hour"),
            F.col("start_ts").alias("release_ts"),
            F.col("end_ts").alias("arrived_ts"),
            s.alias("switch_s"),
        )
    )


def _cells(t: Tables) -> DataFrame:
    return exact_quantiles(
        switch_intervals(t), CELL, "switch_s", {"median_s": 0.5}, count="switches", mean="mean_s"
    )


def switch_station_hour(t: Tables) -> DataFrame:
    """Median, mean and count per station and hour over 24 hours; NULL if idle."""
    cells = _cells(t)
    days = day_start(cells).select("op_day", "day_ts").distinct()
    grid = ticks(t.day_stations().join(days, "op_day"), "HOUR", 24, "hour")
    return complete_grid(grid, cells, CELL, {"switches": 0}).drop("day_ts")


def switch_fleet(t: Tables) -> DataFrame:
    """Median and mean of all switches of the day."""
    return exact_quantiles(
        switch_intervals(t), ["op_day"], "switch_s", {"median_s": 0.5}, mean="mean_s"
    )


def switch_anchor(t: Tables) -> DataFrame:
    """p95 over the median and mean cells together."""
    cells = switch_station_hour(t)
    both = cells.select("op_day", F.col("median_s").alias("v")).unionByName(
        cells.select("op_day", F.col("mean_s").alias("v"))
    )
    return both.groupBy("op_day").agg(F.percentile("v", 0.95).alias("p95_s")).where(
        F.col("p95_s").isNotNull()
    )
