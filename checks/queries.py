"""Registered queries: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as A
from stationflow.operators import days, quality
from stationflow.operators.pairing import dwell_pairs, pick_pairs, switch_pairs
from stationflow.operators.overlap import overlap_count
from stationflow.operators.slicing import occupied_seconds
from stationflow.operators.stations import design_total, detect_robot_type
from stationflow.plans import cycle, dwell, fleet, registry, retrieval, summary, switch, throughput, workbook
from stationflow.session import ensure_checkpoint_dir, written
from stationflow.sources import eventlog, sinks
from stationflow.sources import overrides as settings
from stationflow.sources import tables as source_tables
from stationflow.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places with ties up, counts as BIGINT."""
    casts = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            casts[name] = F.round(F.col(name) + 1e-9, 6)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            casts[name] = F.col(name).cast("bigint")
    return df.withColumns(casts) if casts else df


def _on_tables(fn: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf: tidy(fn(A.tables(spark, sf)))


def _on_rated(fn: Callable[[Tables], DataFrame]) -> Query:
    """With the user settings applied."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = settings.parse_overrides(A.settings(A.events(spark, sf)))
        return tidy(fn(A.tables(spark, sf, rows)))

    return query


def _on_wide(fn: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf: tidy(fn(A.wide_lifecycle(spark, sf)))


def _on_events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: tidy(fn(A.events(spark, sf)))


def _on_log(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_events(lambda ev: fn(eventlog.parse_entries(A.log_lines(ev))))


def _entry_rows(entries: DataFrame) -> DataFrame:
    return entries.select("op_day", "label", "ts", "event", F.col("payload.data.id").alias("data_id"))


def _scratch(spark: SparkSession) -> str:
    """A new folder name in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    tag = spark.sql("SELECT uuid() AS u").first()["u"]
    return f"{spark.sparkContext.getCheckpointDir()}/checks-{tag}"


def _on_clustered(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """On station events that were stored by robot, day and block of time."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = _scratch(spark)
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        return tidy(fn(sinks.write_clustered(A.tables(spark, sf).station_event, name, path)))

    return query


def _read_log(spark: SparkSession, sf: str, multiline: bool) -> DataFrame:
    """Write the log lines as text files and read those."""
    path = _scratch(spark)
    A.log_lines(A.events(spark, sf)).select("value").write.text(path)
    return _entry_rows(eventlog.read_event_log(spark, path, multiline)).drop("label")


def _payload_fields(ev: DataFrame) -> DataFrame:
    """Fields that no table is built from, by path, after the entries were stored as Parquet."""
    kept = written(eventlog.parse_entries(A.log_lines(ev), whole=True))
    return kept.select(
        "op_day", "ts", "event",
        eventlog.payload_field("$.route[1].hop", "bigint").alias("second_hop"),
        eventlog.payload_field("$.battery", "int").alias("battery"),
        eventlog.payload_field("$.route", "bigint").alias("no_number"),
        eventlog.message_field("$.robotCode").alias("robot"),
    )


def _sql_day(spark: SparkSession, sf: str) -> DataFrame:
    """Two results joined in SQL, for a day given as a parameter."""
    t = A.tables(spark, sf)
    day = t.station_event.agg(F.min("op_day")).first()[0]
    registry.create_views(t, "throughput_station_hour", "pick_station_hour", prefix="day_")
    return tidy(
        spark.sql(
            """SELECT op_day, station, hour, completions, mean_s
               FROM day_throughput_station_hour LEFT JOIN day_pick_station_hour USING (op_day, station, hour)
               WHERE op_day = :day""",
            args={"day": day},
        )
    )


def _undated_pairs(ev: DataFrame) -> DataFrame:
    """All events in one undated file: one load, whose pairs run over midnight."""
    lines = A.log_lines(ev).withColumn("file_name", F.lit("flow.log"))
    return pick_pairs(eventlog.build_station_event(eventlog.load_days(eventlog.parse_entries(lines))))


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Log files of the first days are ingested, then all files, then nothing new.

    The files have no date in their names, so a day is that of its file's first entry.
    """
    files, folder = _scratch(spark), _scratch(spark)
    # Short events are dealt by day, and their long lines made after that.
    ev = A.events(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "op_day")
    early = F.col("op_day") < ev.agg(F.date_add(F.min("op_day"), 3)).scalar()
    for part in (early, ~early):
        lines = A.log_lines(ev.where(part)).withColumn("day", F.regexp_extract("file_name", eventlog.FILE_DATE, 1))
        one_a_day = lines.sortWithinPartitions("day", "line").select("value", "day")
        one_a_day.write.mode("append").partitionBy("day").text(files)
        eventlog.ingest_new(spark, files, folder, multiline=False)
    return eventlog.ingest_new(spark, files, folder, multiline=False).station_event.drop("op_day", "row_id", "load")


def _load_issues(spark: SparkSession, sf: str) -> DataFrame:
    """A load with bad times, few tasks without durations, and days in two callback tables."""
    ev, folder = A.events(spark, sf), _scratch(spark)
    top = ev.agg(F.max("event_id").alias("m")).scalar()
    raw = {
        "first": A.source_callback(ev), "second": A.source_callback(ev.where("user_id % 2 = 1 AND day(op_day) > 20")),
        "station": A.source_station(ev),
        "任务生命周期": A.source_lifecycle(ev.where(F.col("event_id") > top - 5)).select("任务编号", "complete(任务完成时间)"),
    }
    names = {name: f"{folder}/{i}" for i, name in enumerate(raw)}
    for name, df in raw.items():
        df.write.parquet(names[name])
    return source_tables.load_tables(spark, names, f"{folder}/canonical", strict=False)[1]


def _on_read_back(fn: Callable[[Tables], DataFrame]) -> Query:
    """On the canonical tables, written and read again."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        folder = _scratch(spark)
        sinks.write_raw(A.tables(spark, sf), folder, by_day=False)
        return tidy(fn(source_tables.read_canonical(spark, folder)))

    return query


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    ev = A.events(spark, sf)
    raw = {
        "callback": A.source_callback(ev),
        "station": A.source_station(ev),
        "lifecycle": A.source_lifecycle(ev),
    }
    return quality.check_tables(spark, raw)


def _few_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Small and empty tables made from the rarest values of the data."""
    ev = A.events(spark, sf)
    top = ev.agg(F.max("event_id").alias("m")).scalar()
    few = A.source_station(ev.where(F.col("event_id") > top - 5))
    none = A.source_station(ev.where(F.col("event_id") > top))
    return quality.check_table("station", few).unionByName(
        quality.check_table("station", none).withColumn("table", F.lit("station_empty"))
    )


def _duplicate_days(ev: DataFrame) -> DataFrame:
    """Events of odd users arrive in a second load that lacks the first days."""
    late = (F.col("user_id") % 2 == 1) & (F.dayofmonth("op_day") > 20)
    loads = ev.select("op_day", F.when(late, "second").otherwise("first").alias("source"))
    return quality.duplicate_days(loads)


def _identify(spark: SparkSession, sf: str) -> DataFrame:
    ev = A.events(spark, sf)
    named = {
        "a": A.source_lifecycle(ev),
        "b": A.source_callback(ev),
        "c": A.source_station(ev),
    }
    parts = [
        df.select(F.lit(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
        for kind, df in source_tables.identify(named).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return tidy(out)


def _canonical_lifecycle(ev: DataFrame) -> DataFrame:
    df = source_tables.canonical_lifecycle(A.source_lifecycle(ev), "K50")
    return df.select(
        "op_day", "task_code", "container_id", "source_loc", "dest_loc", "completed_ts", "total_s",
        "leg_s", "shuttle_s",
    )


def _stage_unpivot(ev: DataFrame) -> DataFrame:
    raw = A.source_lifecycle(ev)
    rows = source_tables.lifecycle_stages(raw, source_tables.used_stages(raw))
    return rows.groupBy("stage", "stage_label", "stage_ord").agg(
        F.count("seconds").alias("n"), F.sum("seconds").alias("total_s")
    )


def _storage(t: Tables) -> DataFrame:
    return retrieval.storage_rows(t.lifecycle).select("op_day", "task_code", "aisle", "bay", "level")


def _json_rows(t: Tables) -> DataFrame:
    """Effective tasks per cell with NaN and infinity planted where there are none."""
    rows = throughput.effective_tasks(t)
    value = (
        F.when(F.col("effective_tasks") == 0, F.lit(float("inf")))
        .when(F.col("effective_tasks").isNull(), F.lit(float("nan")))
        .otherwise(F.col("effective_tasks"))
    )
    return sinks.json_safe(rows.withColumn("effective_tasks", value))


def _written(spark: SparkSession, sf: str, fn, fmt: str) -> DataFrame:
    """Write a result, a folder per day, and read it back."""
    df = fn(A.tables(spark, sf))
    path = _scratch(spark)
    sinks.write_result(df, path, fmt)
    back = spark.read.format(fmt).schema(df.schema)
    if fmt == "csv":
        back = back.option("header", True)
    return tidy(back.load(path).select(*df.columns))


def _depth(t: Tables) -> DataFrame:
    return fleet.queue_depth(t).select("op_day", "station", "row_id", "leg_s", "depth")


def _overlap_all(ev: DataFrame) -> DataFrame:
    """Overlap of all leg intervals per destination, over all days."""
    rows = A.lifecycle(ev).select(
        F.col("dest_loc").alias("station"), "row_id", F.col("completed_ts").alias("start_ts"),
        (F.col("completed_ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"),
    )
    return overlap_count(rows, ["station"], "row_id", "start_ts", "end_ts").select(
        "station", "row_id", "depth"
    )


def queries() -> dict[str, Query]:
    return {
        # Sources
        "s1_read_log": lambda spark, sf: _read_log(spark, sf, False),
        "s1_read_log_multiline": lambda spark, sf: _read_log(spark, sf, True),
        "s2_log_entries": _on_log(_entry_rows),
        "s2_payload_fields": _on_events(_payload_fields),
        "s4_log_days": _on_log(eventlog.log_days),
        "s4_undated_pairs": _on_events(_undated_pairs),
        "s4_incremental_ingest": _ingested,
        "s5_callback": _on_log(lambda e: eventlog.build_callback(e).drop("row_id")),
        "s6_station_event": _on_log(lambda e: eventlog.build_station_event(e).drop("row_id")),
        "s7_lifecycle_fold": _on_log(lambda e: eventlog.build_lifecycle(e).drop("row_id")),
        "s9_identify": _identify,
        "s9_canonical_lifecycle": _on_events(_canonical_lifecycle),
        "s10_station_overrides": _on_rated(lambda t: t.stations),
        "s10_design_total": _on_rated(lambda t: design_total(t.stations)),
        "s11_written_parquet": lambda spark, sf: _written(
            spark, sf, throughput.station_hour, "parquet"
        ),
        "s11_written_csv": lambda spark, sf: _written(spark, sf, throughput.implied_capacity, "csv"),
        "s12_json_safe": _on_tables(_json_rows),
        "s13_raw_station": _on_read_back(lambda t: t.station_event),
        "s13_read_back_stages": _on_read_back(cycle.stage_shares),
        # Quality
        "v3_quality_report": _quality,
        "v2_few_rows": _few_rows,
        "v6_load_issues": _load_issues,
        "v5_settings": _on_events(
            lambda ev: settings.check_settings(A.settings(ev).unionByName(
                ev.groupBy().agg(F.concat(
                    F.lit('{"design_rates": {"LABOR-1": "fast"}, "amr_type": '),
                    F.count_distinct("user_id"), F.lit(', "colour": 1}'),
                ).alias("text"))
            ))
        ),
        "v6_duplicate_days": _on_events(_duplicate_days),
        # Dimensions and filters
        "p1_station_dim": _on_tables(lambda t: t.stations),
        "p3_robot_type": _on_tables(lambda t: detect_robot_type(t.station_event)),
        "p8_peak_day": _on_tables(lambda t: days.peak_day(t.callback)),
        "p8_peak_day_rows": _on_tables(
            lambda t: throughput.station_hour(days.keep_peak_day(t))
        ),
        "p9_data_date": lambda spark, sf: days.data_date(spark, A.tables(spark, sf)),
        "p10_storage_parts": _on_tables(_storage),
        "p12_stage_unpivot": _on_events(_stage_unpivot),
        # Pairs, slices and overlaps
        "w1_pick_pairs": _on_tables(lambda t: pick_pairs(t.station_event)),
        "w2_switch_pairs": _on_tables(lambda t: switch_pairs(t.station_event, "location_code")),
        "w1_clustered_pairs": _on_clustered(pick_pairs),
        "w3_clustered_pairs": _on_clustered(dwell_pairs),
        "w3_dwell_pairs": _on_tables(lambda t: dwell_pairs(t.station_event)),
        "j5_overlap_all_days": _on_events(_overlap_all),
        # Throughput
        "q01_throughput_station_hour": _on_tables(throughput.station_hour),
        "q02_total_hour": _on_rated(throughput.total_hour),
        "q03_occupied_seconds": _on_tables(
            lambda t: occupied_seconds(
                switch_pairs(t.located()).where("seconds < 7200"), ["op_day", "station"]
            )
        ),
        "q04_active_time": _on_tables(throughput.active_time),
        "q05_effective_tasks": _on_tables(throughput.effective_tasks),
        "q06_implied_capacity": _on_tables(throughput.implied_capacity),
        "q07_implied_share": _on_tables(throughput.implied_share),
        "q08_picker_rate": _on_tables(throughput.picker_rate),
        "q09_design_utilisation": _on_rated(throughput.design_utilisation),
        "q10_target_share": _on_rated(throughput.target_share),
        "q11_cell_summary": _on_tables(throughput.cell_summary),
        # Pick time
        "q12_pick_intervals": _on_tables(dwell.pick_intervals),
        "q13_pick_station_hour": _on_tables(dwell.pick_station_hour),
        "q14_weighted_pick": _on_tables(dwell.weighted_pick),
        "q15_scale_anchors": _on_tables(dwell.scale_anchors),
        "q16_pick_density": lambda spark, sf: tidy(
            dwell.pick_density(A.direct_picks(spark, sf), by=[])
        ),
        "q16_pick_density_day": _on_tables(lambda t: dwell.pick_density(dwell.pick_intervals(t))),
        "q17_pick_averages": lambda spark, sf: tidy(
            dwell.pick_averages(A.direct_picks(spark, sf), by=[])
        ),
        "q18_occupancy": _on_tables(dwell.occupancy),
        "q18_occupancy_summary": _on_tables(dwell.occupancy_summary),
        "q19_pick_vs_throughput": _on_tables(dwell.pick_vs_throughput),
        "q19_pick_vs_throughput_fit": _on_tables(dwell.pick_vs_throughput_fit),
        # Switch time
        "q20_switch_intervals": _on_tables(switch.switch_intervals),
        "q21_switch_station_hour": _on_tables(switch.switch_station_hour),
        "q22_switch_fleet": _on_tables(switch.switch_fleet),
        "q22_switch_anchor": _on_tables(switch.switch_anchor),
        # Cycle time
        "q23_cycle_rows": _on_tables(cycle.cycle_rows),
        "q24_cycle_histogram": _on_tables(cycle.cycle_histogram),
        "q24_cycle_summary": _on_tables(cycle.cycle_summary),
        "q25_cycle_by_hour": _on_tables(cycle.cycle_by_hour),
        "q26_demand_vs_cycle": _on_tables(cycle.demand_vs_cycle),
        "q26_demand_vs_cycle_fit": _on_tables(cycle.demand_vs_cycle_fit),
        "q27_stage_shares": _on_tables(cycle.stage_shares),
        "q28_stage_by_station": _on_tables(cycle.stage_by_station),
        "q29_cycle_describe": _on_tables(cycle.cycle_describe),
        # Retrieval
        "q30_aisle_demand": _on_tables(retrieval.aisle_demand),
        "q30_aisle_demand_wide": _on_wide(lambda t: retrieval.aisle_demand(t, by=[])),
        "q31_bay_demand": _on_tables(retrieval.bay_demand),
        "q31_bay_demand_wide": _on_wide(lambda t: retrieval.bay_demand(t, by=[])),
        "q32_ranked_totes": _on_tables(retrieval.ranked_totes),
        "q32_ranked_totes_wide": _on_wide(lambda t: retrieval.ranked_totes(t, by=[])),
        "q32_tote_totals": _on_wide(lambda t: retrieval.tote_totals(t, by=[])),
        "q33_cohort_volume": _on_tables(retrieval.cohort_volume),
        "q33_cohort_volume_wide": _on_wide(lambda t: retrieval.cohort_volume(t, by=[])),
        "q34_pareto_curve": _on_wide(lambda t: retrieval.pareto_curve(t, by=[])),
        "q34_pareto_marks": _on_wide(lambda t: retrieval.pareto_marks(t, by=[])),
        "q34_pareto_marks_day": _on_tables(retrieval.pareto_marks),
        # Fleet
        "q35_queue_depth": _on_tables(_depth),
        "q36_leg_by_depth": _on_tables(fleet.leg_by_depth),
        "q37_depth_box": _on_tables(fleet.depth_box),
        "q37_depth_summary": _on_tables(fleet.depth_summary),
        "q38_task_intervals": _on_tables(fleet.task_intervals),
        "q38_station_intervals": _on_tables(fleet.station_intervals),
        "q39_fleet_timeline": _on_tables(fleet.fleet_timeline),
        "q40_fleet_summary": _on_tables(fleet.fleet_summary),
        "q41_active_robots": _on_tables(fleet.active_robots),
        "q42_leg_describe": _on_tables(fleet.leg_describe),
        "q42_leg_rows": _on_tables(fleet.leg_rows),
        # Summary
        "q43_daily_stats": _on_tables(summary.daily_stats),
        "q44_pick_by_station": _on_tables(summary.pick_by_station),
        "q45_implied_by_station": _on_tables(summary.implied_by_station),
        "q45_implied_by_day": _on_tables(summary.implied_by_day),
        "q46_headline_trend": _on_tables(summary.headline_trend),
        "q47_day_changes": _on_tables(summary.day_changes),
        "q48_tail_severity": _on_tables(summary.tail_severity),
        "q49_hourly_consistency": _on_tables(summary.hourly_consistency),
        "q50_overlay_stats": _on_tables(summary.overlay_stats),
        "q50_overlay_rows": _on_tables(summary.overlay_rows),
        "q51_cycle_percentiles": _on_tables(summary.cycle_percentiles),
        "q52_pick_fit_by_day": _on_tables(summary.pick_fit_by_day),
        # Workbook tables
        "r1_results_in_sql": _sql_day,
        "q53_throughput_matrix": _on_tables(workbook.throughput_matrix),
        "q54_completion_events": _on_tables(workbook.completion_events),
        "q55_pick_events": _on_tables(workbook.pick_events),
        "q56_switch_events": _on_tables(workbook.switch_events),
        "q57_utilisation_chain": _on_tables(workbook.utilisation_chain),
        "q58_pick_matrix": _on_tables(workbook.pick_matrix),
    }
