"""Result name -> function of the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stationflow.plans import cycle, dwell, fleet, retrieval, summary, switch, throughput, workbook
from stationflow.tables import Tables

Result = Callable[[Tables], DataFrame]

_STATION = ("station_event",)
_LIFECYCLE = ("lifecycle",)
_STAGES = ("station_event", "stage")
_ALL = ("station_event", "callback", "lifecycle")

# name: (tables it needs, function)
RESULTS: dict[str, tuple[tuple[str, ...], Result]] = {
    "throughput_station_hour": (_STATION, throughput.station_hour),
    "throughput_total_hour": (_STATION, throughput.total_hour),
    "throughput_detail": (_STATION, throughput.station_hour_detail),
    "throughput_picker_rate": (_STATION, throughput.picker_rate),
    "throughput_utilisation": (_STATION, throughput.design_utilisation),
    "throughput_target_share": (_STATION, throughput.target_share),
    "throughput_summary": (_STATION, throughput.cell_summary),
    "pick_intervals": (_STATION, dwell.pick_intervals),
    "pick_station_hour": (_STATION, dwell.pick_station_hour),
    "pick_weighted": (_STATION, dwell.weighted_pick),
    "pick_anchors": (_STATION, dwell.scale_anchors),
    "pick_density": (_STATION, lambda t: dwell.pick_density(dwell.pick_intervals(t))),
    "pick_averages": (_STATION, lambda t: dwell.pick_averages(dwell.pick_intervals(t))),
    "occupancy": (_STATION, dwell.occupancy),
    "occupancy_summary": (_STATION, dwell.occupancy_summary),
    "pick_vs_throughput": (_STATION, dwell.pick_vs_throughput),
    "pick_vs_throughput_fit": (_STATION, dwell.pick_vs_throughput_fit),
    "switch_intervals": (_STATION, switch.switch_intervals),
    "switch_station_hour": (_STATION, switch.switch_station_hour),
    "switch_fleet": (_STATION, switch.switch_fleet),
    "switch_anchor": (_STATION, switch.switch_anchor),
    "cycle_rows": (_LIFECYCLE, cycle.cycle_rows),
    "cycle_histogram": (_LIFECYCLE, cycle.cycle_histogram),
    "cycle_summary": (_LIFECYCLE, cycle.cycle_summary),
    "cycle_by_hour": (_LIFECYCLE, cycle.cycle_by_hour),
    "demand_vs_cycle": (("lifecycle", "callback"), cycle.demand_vs_cycle),
    "demand_vs_cycle_fit": (("lifecycle", "callback"), cycle.demand_vs_cycle_fit),
    "stage_shares": (("lifecycle", "stage"), cycle.stage_shares),
    "stage_by_station": (_STAGES, cycle.stage_by_station),
    "cycle_describe": (_LIFECYCLE, cycle.cycle_describe),
    "retrieval_aisle": (_LIFECYCLE, retrieval.aisle_demand),
    "retrieval_bay": (_LIFECYCLE, retrieval.bay_demand),
    "retrieval_totes": (_LIFECYCLE, retrieval.ranked_totes),
    "retrieval_tote_totals": (_LIFECYCLE, retrieval.tote_totals),
    "retrieval_cohorts": (_LIFECYCLE, retrieval.cohort_volume),
    "retrieval_pareto": (_LIFECYCLE, retrieval.pareto_curve),
    "retrieval_pareto_marks": (_LIFECYCLE, retrieval.pareto_marks),
    "queue_depth": (_LIFECYCLE, fleet.queue_depth),
    "leg_by_depth": (_LIFECYCLE, fleet.leg_by_depth),
    "depth_box": (_LIFECYCLE, fleet.depth_box),
    "depth_summary": (_LIFECYCLE, fleet.depth_summary),
    "fleet_intervals": (_STATION, fleet.task_intervals),
    "fleet_timeline": (_STATION, fleet.fleet_timeline),
    "fleet_summary": (_STATION, fleet.fleet_summary),
    "fleet_active_robots": (_STATION, fleet.active_robots),
    "leg_describe": (("station_event", "lifecycle"), fleet.leg_describe),
    "leg_rows": (_LIFECYCLE, fleet.leg_rows),
    "daily_stats": (_ALL, summary.daily_stats),
    "pick_by_station": (_STATION, summary.pick_by_station),
    "implied_by_station": (_STATION, summary.implied_by_station),
    "implied_by_day": (_STATION, summary.implied_by_day),
    "headline_trend": (_ALL, summary.headline_trend),
    "day_changes": (_ALL, summary.day_changes),
    "tail_severity": (_ALL, summary.tail_severity),
    "hourly_consistency": (("callback",), summary.hourly_consistency),
    "overlay_stats": (_LIFECYCLE, summary.overlay_stats),
    "overlay_rows": (_LIFECYCLE, summary.overlay_rows),
    "cycle_percentiles": (_LIFECYCLE, summary.cycle_percentiles),
    "pick_fit_by_day": (("station_event", "callback"), summary.pick_fit_by_day),
    "completion_events": (_STATION, workbook.completion_events),
    "throughput_matrix": (_STATION, workbook.throughput_matrix),
    "pick_events": (_STATION, workbook.pick_events),
    "switch_events": (_STATION, workbook.switch_events),
    "utilisation_chain": (_STATION, workbook.utilisation_chain),
    "pick_matrix": (_STATION, workbook.pick_matrix),
}


_DEPTH = ("queue_depth", "leg_by_depth", "depth_box", "depth_summary")
# Subresult: the results that read it, and how it is written.
SHARED: dict[str, tuple[tuple[str, ...], Result]] = {
    "events": (tuple(n for n, (needs, _) in RESULTS.items() if "station_event" in needs), Tables.share_events),
    "queue_depth": (_DEPTH, fleet.share_depth),
}


def available(t: Tables) -> list[str]:
    """Results whose tables are there."""
    return [
        name
        for name, (needs, _) in RESULTS.items()
        if all(getattr(t, table) is not None for table in needs)
    ]


def run(t: Tables, *names: str) -> dict[str, DataFrame]:
    """The named results, or all available ones, as lazy DataFrames.

    What two or more of them read is written once to the checkpoint folder, before them.
    """
    wanted = names or tuple(available(t))
    for readers, write in SHARED.values():
        if len(set(readers).intersection(wanted)) > 1:
            write(t)
    return {name: RESULTS[name][1](t) for name in wanted}


def create_views(t: Tables, *names: str, prefix: str = "") -> list[str]:
    """Temporary views over the named results, or all available ones, for ``spark.sql``.

    A view is as lazy as its result: a query over it prunes columns and pushes its filters
    on ``op_day`` and other keys down. Days and other values are parameters of the query
    (``spark.sql(text, args=...)``). Returns the names of the views; views of these names
    are replaced.
    """
    found = {prefix + name: df for name, df in run(t, *names).items()}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return list(found)
