import pytest
from conftest import DAY, at
from pyspark.sql import functions as F

from stationflow import session
from stationflow.operators import days, quality
from stationflow.operators.stations import build_station_dim, detect_robot_type
from stationflow.plans import registry, retrieval, throughput
from stationflow.sources import overrides
from stationflow.tables import Tables

POINTS = [
    ("00:00:01", "arrived", "LT_LABOR:POINT:2:0", "r"), ("00:00:02", "arrived", "LT_LABOR:POINT:1:1", "r"),
    ("00:00:03", "arrived", "LT_LABOR:POINT:1:0", "r"), ("00:00:04", "arrived", "LT_LABOR:POINT:x:0", "r"),
    ("00:00:05", "arrived", "LT_LABOR:POINT:1", "r"), ("00:00:06", "arrived", "STORE:POINT:1:0", "r"),
    ("00:00:07", "arrived", None, "r"),
]


def test_station_dim(make_events):
    dim = build_station_dim(make_events(POINTS)).orderBy("station_ord").collect()
    assert [(r["x"], r["y"], r["station"], r["zone"]) for r in dim] == [
        (1, 0, "LABOR-1", "Zone A"), (2, 0, "LABOR-2", "Zone A"), (1, 1, "LABOR-3", "Zone B")
    ]


def test_overrides_and_names(spark, make_events):
    text = '{"station_types": {"LABOR-1": "Fast", "LABOR-9": "x"}, "design_rates": {"LABOR-2": 70, "Fast": 90.5}}'
    rows = overrides.parse_overrides(spark.createDataFrame([(text,)], "text string"))
    dim = {r["station"]: (r["zone"], r["design_rate"]) for r in build_station_dim(make_events(POINTS), rows).collect()}
    assert dim == {"LABOR-1": ("Fast", 90), "LABOR-2": ("Zone A", 70), "LABOR-3": ("Zone B", None)}
    names = spark.createDataFrame([("LT_LABOR:POINT:1:0", "Dock")], "location_code string, station string")
    named = build_station_dim(make_events(POINTS), names=names)
    assert {r["station"] for r in named.collect()} == {"Dock", "LABOR-2", "LABOR-3"}


def test_settings_checks(spark, make_tables, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"amr_type": "Z9", "station_types": {"LABOR-1": "A"}}')
    read = overrides.read_settings(spark, str(path))
    assert overrides.check_settings(read).count() == 0
    t = make_tables(POINTS, overrides=overrides.parse_overrides(read))
    assert t.robot_type == "Z9"

    def checks(text):
        df = spark.createDataFrame([(text,)], "text string")
        return sorted((r["severity"], r["check"], r["detail"]) for r in overrides.check_settings(df).collect())

    assert checks("[1]") == [("error", "json_object", "settings must be a JSON object")]
    assert checks("{oops") == [("error", "json_object", "settings must be a JSON object")]
    bad = '{"zoom": 1, "station_types": [], "amr_type": 5, "design_rates": {"a": "x", "b": 2}}'
    assert checks(bad) == [
        ("error", "numeric_rate", "a"), ("error", "object", "station_types"),
        ("error", "string", "amr_type"), ("warning", "unknown_keys", "zoom"),
    ]
    assert overrides.parse_overrides(spark.createDataFrame([(bad,)], "text string")).count() == 0


def test_per_day_numbering(make_events):
    first = make_events([("00:00:01", "triggerGo", 5, "r")])
    second = make_events([("2026-06-26T00:00:01", "triggerGo", 3, "r")], op_day=at("2026-06-26T00:00:00").date())
    both = first.unionByName(second)
    named = {r["op_day"]: r["station"] for r in throughput.station_hour(Tables(both, per_day=True)).collect()}
    assert set(named.values()) == {"LABOR-1"}
    named = {r["op_day"]: r["station"] for r in throughput.station_hour(Tables(both)).collect()}
    assert named == {DAY: "LABOR-2", at("2026-06-26T00:00:00").date(): "LABOR-1"}


def test_robot_type(make_events):
    rows = [("00:00:02", "arrived", 1, "a", "A42"), ("00:00:01", "arrived", 1, "b", "K50"), ("00:00:03", "x", 1, "c", "Z50")]
    assert detect_robot_type(make_events(rows)).first()[0] == "K50"
    assert detect_robot_type(make_events(rows[:1])).first()[0] == "A42"


def test_lookup_is_broadcast_only_when_small(spark):
    df = spark.range(50)
    assert "broadcast" in session.settle(df, 50)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in session.settle(df, 49)._jdf.queryExecution().analyzed().toString().lower()


def retrievals(make_lifecycle, counts):
    return Tables(lifecycle=make_lifecycle(
        [{"container_id": tote, "source_loc": "HAI-1-1-1-1"} for tote, n in counts.items() for _ in range(n)]
    ))


def test_pareto(make_lifecycle):
    t = retrievals(make_lifecycle, {"a": 5, "b": 3, "c": 1, "d": 1})
    curve = retrieval.pareto_curve(t).orderBy("rank").collect()
    assert [(r["totes_pct"], r["cum_pct"]) for r in curve] == [(25, 50), (50, 80), (75, 90), (100, 100)]
    assert {r["mark_pct"]: r["cum_pct"] for r in retrieval.pareto_marks(t).collect()} == {5: 50, 20: 50}
    assert [r["container_id"] for r in retrieval.ranked_totes(t).collect()] == list("abcd")


def test_pareto_unfolds_in_chunks(make_lifecycle, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 3)
    t = retrievals(make_lifecycle, {**{f"t{i}": 1 for i in range(10)}, "x": 4})
    curve = retrieval.pareto_curve(t).orderBy("rank").collect()
    assert [r["rank"] for r in curve] == list(range(1, 12))
    assert curve[-1]["cum_pct"] == 100 and curve[0]["cum_pct"] == pytest.approx(400 / 14)


def test_cohorts(make_lifecycle):
    t = retrievals(make_lifecycle, {"a": 1, "b": 1, "c": 2, "d": 25})
    volume = {r["cohort"]: r["volume"] for r in retrieval.cohort_volume(t).collect()}
    assert len(volume) == 21 and (volume[1], volume[2], volume[3], volume[21]) == (2, 2, 0, 25)


def test_aisles_and_bays(make_lifecycle):
    rows = [{"source_loc": f"HAI-{a}-{b}-2-1_x"} for a, b, n in ((1, 1, 10), (2, 0, 10), (3, 7, 40)) for _ in range(n)]
    rows += [{"source_loc": s} for s in ("HAI-03", "BUF-1", None)]
    t = Tables(lifecycle=make_lifecycle(rows))
    levels = {r["aisle"]: (r["retrievals"], r["mean_retrievals"], r["level"]) for r in retrieval.aisle_demand(t).collect()}
    assert levels == {"1": (10, 20.0, "normal"), "2": (10, 20.0, "normal"), "3": (40, 20.0, "hot")}
    bays = {(r["aisle"], r["bay"]): r["retrievals"] for r in retrieval.bay_demand(t).collect()}
    assert bays == {(1, 1): 10, (3, 7): 40}  # the grid starts at bay 1
    coded = Tables(lifecycle=make_lifecycle(rows + [{"source_loc": "HAI-Q-9-1-1"}]))
    bays = {(r["aisle"], r["bay"]): r["retrievals"] for r in retrieval.bay_demand(coded).collect()}
    assert bays == {(1, 1): 10, (2, 2): 40, (3, 3): 1}  # codes by first appearance


def test_days(spark, make_callback, make_events):
    rows = [{"ts": at(f"2026-06-2{d}T00:00:0{i}")} for d, n in ((4, 2), (5, 3), (6, 3)) for i in range(n)]
    cb = make_callback(rows).withColumn("op_day", F.to_date("ts"))
    assert str(days.peak_day(cb).first()["op_day"]) == "2026-06-25"
    t = Tables(callback=cb, station_event=make_events(POINTS))
    assert days.keep_peak_day(t).callback.count() == 3
    assert days.data_date(spark, t).first()[0] == "2026-06-24"
    loads = cb.select("op_day", F.when(F.second("ts") == 2, "b").otherwise("a").alias("source"))
    assert sorted(r["detail"] for r in quality.duplicate_days(loads).collect()) == ["2026-06-25", "2026-06-26"]


def test_missing_tables_leave_results_out(make_lifecycle):
    names = registry.available(Tables(lifecycle=make_lifecycle([{}])))
    assert "cycle_describe" in names and "throughput_detail" not in names and "stage_shares" not in names
