"""Concurrent deliveries per station and fleet utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions import stats
from stationflow.functions.text import is_labor
from stationflow.functions.times import floor_to, minus_seconds
from stationflow.operators.stations import with_delivers
from stationflow.operators.overlap import active_at, bin_span, overlap_count
from stationflow.operators.pairing import dwell_pairs
from stationflow.operators.quantiles import exact_quantiles
from stationflow.session import settle
from stationflow.tables import Tables

QUINTILES = {f"q{k}": k / 5 for k in range(6)}
FLEET = ["op_day", "fleet"]


def leg_rows(t: Tables) -> DataFrame:
    """Deliveries to labor stations with a leg in (0, 3600) s."""
    leg = F.col("leg_s")
    return t.lifecycle.where(
        (leg > 0) & (leg < S.LEG_DEPTH_MAX_S) & is_labor(F.col("dest_loc"))
    ).select("op_day", "row_id", F.col("dest_loc").alias("station"), "leg_s", "completed_ts")


def queue_depth(t: Tables) -> DataFrame:
    """Each delivery with the number of deliveries to its station it overlaps."""
    shared = t.found("queue_depth")
    return _queue_depth(t) if shared is None else shared


def share_depth(t: Tables) -> DataFrame:
    """The overlap, worked out once; from now on all results start from it."""
    return t.kept("queue_depth", lambda: _queue_depth(t))


def _queue_depth(t: Tables) -> DataFrame:
    rows = leg_rows(t).where(F.col("completed_ts").isNotNull())
    rows = rows.withColumn("start_ts", minus_seconds(F.col("completed_ts"), F.col("leg_s")))
    return overlap_count(
        rows, ["op_day", "station"], "row_id", "start_ts", "completed_ts", "depth"
    )


def depth_edges(depths: DataFrame) -> DataFrame:
    """Bin edges per day from the quintiles of depth, rounded half to even.

    ``depths`` has ``op_day, depth`` and the number ``n`` of deliveries.
    """
    cuts = exact_quantiles(depths, ["op_day"], "depth", QUINTILES, weight="n")
    edges = F.array_distinct(F.array(*[F.bround(F.col(q)).cast("bigint") for q in QUINTILES]))
    flat = F.array(F.lit(1), F.greatest(F.lit(2), F.col("q5").cast("bigint") + 1))
    return cuts.select(
        "op_day", F.when(F.size(edges) < 2, flat).otherwise(edges).alias("edges")
    )


def leg_by_depth(t: Tables) -> DataFrame:
    """Median leg per depth bin; bins without deliveries are left out.

    Edges and medians both start from the counts of (depth, leg), so the overlap
    is worked out once.
    """
    depths = queue_depth(t).groupBy("op_day", "depth", "leg_s").agg(F.count("*").alias("n"))
    upper = F.slice(F.col("edges"), 2, F.size("edges"))
    index = F.size(F.filter(upper, lambda e: e < F.col("depth")))
    bins = F.size("edges") - 1
    low, high = F.try_element_at("edges", F.col("bin") + 1), F.try_element_at(
        "edges", F.col("bin") + 2
    )
    label = (
        F.when(F.col("bin") == 0, F.concat(F.lit("<"), high))
        .when(F.col("bin") == bins - 1, F.concat(low, F.lit("+")))
        .otherwise(F.concat(low, F.lit("–"), high))
    )
    binned = (
        depths.join(depth_edges(depths), "op_day")
        .withColumn("bin", index)
        .where(F.col("bin") < bins)
        .withColumn("label", label)
    )
    return exact_quantiles(
        binned, ["op_day", "bin", "label"], "leg_s", {"median_leg_s": 0.5}, count="deliveries",
        weight="n",
    )


def depth_box(t: Tables) -> DataFrame:
    """Box statistics of depth per station."""
    named = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return exact_quantiles(queue_depth(t), ["op_day", "station"], "depth", named)


def depth_summary(t: Tables) -> DataFrame:
    """Correlation of depth and leg; range and middle of the station medians."""
    x, y = F.col("depth").cast("double"), F.col("leg_s")
    r = share_depth(t).groupBy("op_day").agg(stats.corr(x, y).alias("pearson_r"))
    low, high = F.min("median").cast("bigint"), F.max("median").cast("bigint")
    medians = depth_box(t).groupBy("op_day").agg(
        low.alias("median_low"),
        high.alias("median_high"),
        F.floor((low + high) / 2).alias("median_mid"),
    )
    return r.join(medians, "op_day")


def _robot_events(t: Tables) -> DataFrame:
    """Events of known robots with their fleet: those of the day's type deliver."""
    known = F.col("ts").isNotNull() & F.col("robot_id").isNotNull() & F.col("robot_type").isNotNull()
    rows = t.events().where(known)
    if "delivers" not in rows.columns:
        rows = with_delivers(rows, t.day_types)
    return rows.withColumn("fleet", F.when(F.col("delivers"), "delivery").otherwise("shuttle")).drop("delivers")


def _robot_spans(t: Tables) -> DataFrame:
    """First and last event of each robot and fleet of a day."""
    return t.kept(
        "robot_spans",
        lambda: _robot_events(t).groupBy(*FLEET, "robot_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")),
    )


def lifecycle_intervals(t: Tables) -> DataFrame:
    """Delivery legs, and shuttle stages that end where the leg starts."""
    leg = F.col("leg_s")
    rows = t.lifecycle.where(
        (leg > 0) & (leg < S.LEG_UTIL_MAX_S) & F.col("completed_ts").isNotNull()
    ).withColumn("leg_start", minus_seconds(F.col("completed_ts"), leg))

    def interval(fleet: str, start, end):
        return F.struct(F.lit(fleet).alias("fleet"), start.alias("start_ts"), end.alias("end_ts"))

    both = [interval("delivery", F.col("leg_start"), F.col("completed_ts"))]
    if "shuttle_s" in rows.columns:
        begin = minus_seconds(F.col("leg_start"), F.col("shuttle_s"))
        shuttle = interval("shuttle", begin, F.col("leg_start"))
        both.append(F.when((F.col("shuttle_s") > 0) & (begin < F.col("leg_start")), shuttle))
    # One pass over the tasks gives both fleets.
    return rows.select("op_day", F.inline(F.array_compact(F.array(*both))))


def station_intervals(t: Tables) -> DataFrame:
    """Robot dwell at stations; for a fleet without any, each robot's whole span."""
    return _dwell_or_span(_robot_events(t), _robot_spans(t))


def _dwell_or_span(events: DataFrame, spans: DataFrame) -> DataFrame:
    dwell = dwell_pairs(events, carry=["fleet"]).select(*FLEET, "start_ts", "end_ts")
    without = spans.join(dwell.select(*FLEET).distinct(), FLEET, "left_anti")
    return dwell.unionByName(without.select(*FLEET, "start_ts", "end_ts"))


def task_intervals(t: Tables) -> DataFrame:
    """On-task intervals: from lifecycle where a day has any, else from stations.

    ``source`` tells which. A lifecycle table without shuttle stages leaves the
    shuttle fleet to the station intervals. Only events of what is left are paired.
    """
    events = _robot_events(t)
    if t.lifecycle is None:
        return _dwell_or_span(events, _robot_spans(t)).withColumn("source", F.lit("station"))
    tasks = lifecycle_intervals(t)
    covered = tasks.select("op_day").distinct()
    on = ["op_day"]
    if "shuttle_s" not in t.lifecycle.columns:
        on, covered = FLEET, covered.withColumn("fleet", F.lit("delivery"))
    covered = settle(covered)
    left, spans = events.join(covered, on, "left_anti"), _robot_spans(t).join(covered, on, "left_anti")
    return tasks.withColumn("source", F.lit("lifecycle")).unionByName(
        _dwell_or_span(left, spans).withColumn("source", F.lit("station"))
    )


def fleet_sizes(t: Tables) -> DataFrame:
    return _robot_spans(t).groupBy(*FLEET).agg(F.count_distinct("robot_id").alias("fleet_size"))


def _fleet_days(t: Tables, intervals: DataFrame) -> DataFrame:
    """Per day and fleet: its size, the bins of the day, and whether the day counts tasks."""
    robots = _robot_spans(t)
    ends = robots.select("op_day", F.explode(F.array("start_ts", "end_ts")).alias("ts"))
    span = bin_span(ends, ["op_day"]).where(F.col("last_bin") > F.col("first_bin"))
    by_tasks = intervals.where(F.col("source") == "lifecycle").select("op_day", F.lit(True).alias("by_tasks")).distinct()
    return fleet_sizes(t).join(span, "op_day").join(by_tasks, "op_day", "left")


def fleet_timeline(t: Tables) -> DataFrame:
    """Robots on task per fleet at the middle of each 5-minute bin.

    Lifecycle intervals count tasks, so the number is capped at the fleet size.
    """
    intervals = t.kept("task_intervals", lambda: task_intervals(t))
    days = t.kept("fleet_days", lambda: _fleet_days(t, intervals))
    counts = active_at(intervals.drop("source"), FLEET, days.select(*FLEET, "first_bin", "last_bin"), "start_ts", "end_ts")
    on_task = F.when(F.col("by_tasks"), F.least("active", "fleet_size")).otherwise(F.col("active"))
    return counts.join(days, FLEET).select(
        *FLEET,
        "mid_ts",
        on_task.alias("on_task"),
        "fleet_size",
        (on_task / F.col("fleet_size") * 100).alias("utilisation_pct"),
    )


def fleet_summary(t: Tables) -> DataFrame:
    """Mean and median over active bins, and the peak."""
    pct = F.col("utilisation_pct")
    busy = F.when(pct > 0, pct)
    zero = F.lit(0.0)
    return (
        fleet_timeline(t)
        .groupBy(*FLEET)
        .agg(
            F.coalesce(F.avg(busy), zero).alias("mean_pct"),
            F.coalesce(F.median(busy), zero).alias("median_pct"),
            F.max(pct).alias("peak_pct"),
        )
    )


def active_robots(t: Tables) -> DataFrame:
    """Distinct robots per type and hour against the type's robots of the day."""
    kind = ["op_day", "robot_type"]
    seen = (
        _robot_events(t)
        .select(*kind, "robot_id", floor_to(F.col("ts"), "HOUR").alias("hour"))
        .distinct()
    )
    hourly = seen.groupBy(*kind, "hour").agg(F.count("*").alias("active_robots"))
    size = seen.groupBy(*kind).agg(F.count_distinct("robot_id").alias("fleet_size"))
    return hourly.join(size, kind).withColumn(
        "utilisation_pct", F.col("active_robots") / F.col("fleet_size") * 100
    )


def leg_describe(t: Tables) -> DataFrame:
    """Delivery leg statistics for every station of the day."""
    rows = leg_rows(t)
    named = {
        "min_s": 0.0, "p25_s": 0.25, "p50_s": 0.5, "p75_s": 0.75, "p90_s": 0.9, "max_s": 1.0,
    }
    key = ["op_day", "station"]
    spread = rows.groupBy(*key).agg(F.stddev_samp("leg_s").alias("std_s"))
    described = exact_quantiles(rows, key, "leg_s", named, count="deliveries", mean="mean_s")
    return t.day_stations().join(described, key, "left").join(spread, key, "left")
