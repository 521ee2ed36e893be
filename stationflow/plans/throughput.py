"""Completions, effective tasks and implied capacity per station and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.stats import ratio
from stationflow.functions.times import floor_to
from stationflow.operators.grid import complete_grid, day_start, ticks
from stationflow.operators.pairing import pick_pairs, switch_pairs
from stationflow.operators.slicing import slice_hours
from stationflow.operators.stations import design_total
from stationflow.tables import Tables

CELL = ["op_day", "station", "hour"]
ROLL_MIN = 10


def _by_time(t: Tables, unit: str, out: str) -> DataFrame:
    done = t.completions().withColumn(out, floor_to(F.col("ts"), unit))
    return done.groupBy("op_day", "station", out).agg(F.count("*").alias("completions"))


def _station_grid(cells: DataFrame, time: str, unit: str, count: int) -> DataFrame:
    rows = day_start(cells, time).select("op_day", "station", "day_ts").distinct()
    return ticks(rows, unit, count, time)


def station_hour(t: Tables) -> DataFrame:
    """Completions per station and hour over 24 hours; stations with at least one."""
    cells = _by_time(t, "HOUR", "hour")
    grid = _station_grid(cells, "hour", "HOUR", 24)
    return complete_grid(grid, cells, CELL, {"completions": 0}).select(*CELL, "completions")


def total_hour(t: Tables) -> DataFrame:
    """All stations per hour, with the day's first peak hour and non-zero mean."""
    day = Window.partitionBy("op_day")
    n = F.col("completions")
    first_peak = F.row_number().over(day.orderBy(F.desc("completions"), "hour"))
    return (
        station_hour(t)
        .groupBy("op_day", "hour")
        .agg(F.sum("completions").alias("completions"))
        .withColumns(
            {
                "is_peak": first_peak == 1,
                "peak": F.max("completions").over(day),
                "avg_nonzero": F.avg(F.when(n > 0, n)).over(day),
                "design_total": design_total(t.stations).scalar(),
            }
        )
    )


def valid_picks(t: Tables) -> DataFrame:
    """Delivery picks longer than 0 s and shorter than an hour, at known stations."""
    s = F.col("seconds")
    pairs = pick_pairs(t.delivery(), carry=["station"])
    return pairs.where((s > 0) & (s < S.PICK_MAX_S) & F.col("station").isNotNull())


def delivery_switches(t: Tables) -> DataFrame:
    s = F.col("seconds")
    return switch_pairs(t.delivery()).where((s >= 0) & (s < S.SWITCH_MAX_S))


def _cell_sums(t: Tables) -> DataFrame:
    """Completions, pick and switch time of every cell that has any, from one grouping."""
    t.share_events()
    picks = slice_hours(valid_picks(t)).select(
        *CELL, F.col("slice_s").alias("pick_s"), "frac", (F.col("frac") * F.col("seconds")).alias("weighted")
    )
    switches = slice_hours(delivery_switches(t)).select(*CELL, F.col("slice_s").alias("switch_s"))
    done = t.completions().select("op_day", "station", floor_to(F.col("ts"), "HOUR").alias("hour"), F.lit(1).alias("done"))
    rows = done.unionByName(picks, allowMissingColumns=True).unionByName(switches, allowMissingColumns=True)
    hour = F.lit(S.HOUR_S)
    return rows.groupBy(*CELL).agg(
        F.count("done").alias("completions"),
        F.when(F.count("pick_s") > 0, F.least(F.sum("pick_s"), hour)).alias("pick_occ"),
        F.sum("frac").alias("tasks"),
        F.sum("weighted").alias("weighted"),
        F.when(F.count("switch_s") > 0, F.least(F.sum("switch_s"), hour)).alias("occupied_s"),
    )


def _full_cells(t: Tables) -> DataFrame:
    """The cell sums over 24 hours of the stations with a completion, with ``has_picks`` per day."""
    sums = t.kept("cell_sums", lambda: _cell_sums(t))
    day = Window.partitionBy("op_day")
    stations = (
        sums.where("completions > 0").groupBy("op_day", "station").agg(F.min("hour").alias("_first"))
        .withColumn("day_ts", floor_to(F.min("_first").over(day), "DAY")).drop("_first")
    )
    full = complete_grid(ticks(stations, "HOUR", 24, "hour").drop("day_ts"), sums, CELL, {"completions": 0})
    return full.withColumn("has_picks", F.max(F.col("tasks").isNotNull()).over(day))


def station_hour_detail(t: Tables) -> DataFrame:
    """Active time, effective tasks, implied capacity and % of it per cell.

    Cells without a completion have no task figures; days without a valid pick
    have none at all.
    """
    zero = F.lit(0.0)
    busy = F.coalesce("pick_occ", zero) + F.coalesce("occupied_s", zero)
    active = F.col("completions") > 0
    mean_pick = ratio(F.col("weighted"), F.col("tasks"))
    effective, capacity = F.col("effective_tasks"), F.col("capacity_tph")
    return (
        _full_cells(t)
        .withColumns(
            {
                "active_pct": F.when(
                    F.col("has_picks"), F.least(busy, F.lit(S.HOUR_S)) / S.HOUR_S * 100
                ),
                "effective_tasks": F.when(F.col("has_picks") & active, F.coalesce("tasks", zero)),
                "capacity_tph": F.when(active, S.HOUR_S / (mean_pick + S.FIXED_SWITCH_S)),
            }
        )
        .withColumn(
            "implied_pct",
            F.when(capacity > 0, F.least(effective / capacity * 100, F.lit(100.0))),
        )
        .select(
            *CELL, "completions", "has_picks", "active_pct", "effective_tasks", "capacity_tph",
            "implied_pct",
        )
    )


def active_time(t: Tables) -> DataFrame:
    return station_hour_detail(t).select(*CELL, "active_pct")


def effective_tasks(t: Tables) -> DataFrame:
    return station_hour_detail(t).select(*CELL, "completions", "effective_tasks")


def implied_capacity(t: Tables) -> DataFrame:
    return station_hour_detail(t).select(*CELL, "capacity_tph")


def implied_share(t: Tables) -> DataFrame:
    return station_hour_detail(t).select(*CELL, "implied_pct")


def picker_rate(t: Tables) -> DataFrame:
    """Per station and minute: trailing 10-minute completions as an hourly rate."""
    cells = _by_time(t, "MINUTE", "minute")
    grid = _station_grid(cells, "minute", "MINUTE", 24 * 60)
    full = complete_grid(grid, cells, ["op_day", "station", "minute"], {"completions": 0})
    by_minute = Window.partitionBy("op_day", "station").orderBy("minute")
    trailing = by_minute.rowsBetween(1 - ROLL_MIN, Window.currentRow)
    rate = F.sum("completions").over(trailing) * (60.0 / ROLL_MIN)
    return full.select(
        "op_day",
        "station",
        "minute",
        F.when(F.row_number().over(by_minute) >= ROLL_MIN, rate).alias("rate_tph"),
    )


def _rates(t: Tables) -> tuple[DataFrame, list[str]]:
    on = [c for c in ("op_day", "station") if c in t.stations.columns]
    return t.stations.select(*on, "design_rate").distinct(), on


def design_utilisation(t: Tables) -> DataFrame:
    """Completions as % of the station's design rate."""
    rates, on = _rates(t)
    n, rate = F.col("completions"), F.col("design_rate")
    pct = F.when((n > 0) & (rate != 0), n / rate * 100)
    return station_hour(t).join(rates, on, "left").withColumn("utilisation_pct", pct)


def target_share(t: Tables) -> DataFrame:
    """Effective tasks, or completions on days without picks, as % of the design rate."""
    rates, on = _rates(t)
    shown = _shown_tasks()
    return (
        station_hour_detail(t)
        .join(rates, on, "left")
        .select(
            *CELL,
            "design_rate",
            F.when(F.col("design_rate") > 0, shown / F.col("design_rate") * 100).alias("target_pct"),
        )
    )


def _shown_tasks():
    n = F.col("completions")
    return F.when(F.col("has_picks"), F.col("effective_tasks")).otherwise(
        F.when(n > 0, n.cast("double"))
    )


def cell_summary(t: Tables) -> DataFrame:
    """Mean and median over the day's active cells."""
    shown, pct = _shown_tasks(), F.col("implied_pct")
    zero = F.lit(0.0)
    return (
        station_hour_detail(t)
        .groupBy("op_day")
        .agg(
            F.coalesce(F.avg(shown), zero).alias("mean_tasks"),
            F.coalesce(F.median(shown), zero).alias("median_tasks"),
            F.coalesce(F.avg(pct), zero).alias("mean_implied_pct"),
            F.coalesce(F.median(pct), zero).alias("median_implied_pct"),
        )
    )
