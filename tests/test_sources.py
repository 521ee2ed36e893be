import json
import random
import re

import pytest
from conftest import at
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.operators import days, quality
from stationflow.operators.pairing import pick_pairs
from stationflow.plans import fleet, registry, throughput
from stationflow.sources import eventlog, sinks, tables
from stationflow.tables import Tables


def entry(ts, event, payload, pretty=False):
    text = json.dumps(payload, indent=2 if pretty else None)
    return f"[{ts}][1][app][env][Cat][{event}] - {text}"


def sent(ts, name, message=None, **payload):
    data = {"name": name, "id": 77}
    if message is not None:
        data["message"] = message if isinstance(message, str) else json.dumps(message)
    return entry(ts, "TASK_EXECUTION_CALLBACK_SENT", {**payload, "data": data})


REACH = "CALLBACK_OF_ROBOT_REACH_STATION"
FINISHED = "CALLBACK_OF_TASK_FINISHED"
LOADED = "CALLBACK_OF_TOTE_LOADED_BY_ROBOT"
AT_1 = {"stationCode": "LABOR-1", "locationCode": "LT_LABOR:POINT:1:2", "robotCode": "robot-1"}
T1 = "2026-06-25T08:00:01.123+08:00"
LINES_1 = [
    sent(T1, REACH, AT_1, taskCode=["ND1"], containerCode=["T9"]),
    sent(T1, REACH, AT_1, taskCode=["ND1"], containerCode=["T9"]),
    "this is no entry",
    "[2026-06-25T08:00:02+08:00][1][app][env][Cat][TASK_EXECUTION_CALLBACK_SENT] - {\"data\": {",
    sent("2026-06-25T08:00:03Z", FINISHED, {**AT_1, "callId": "C5"}, taskCode=["ND1"], taskGroupCode="G1"),
    sent("2026-06-25T08:00:04", FINISHED, {"stationCode": "PORT-1"}),
]
LINES_2 = [
    sent("2026-06-25T08:00:05+08:00", LOADED, {"stationCode": "S", "locationCode": "x:HaiFlex:1"}),
    sent("2026-06-25T08:00:06+08:00", LOADED, "{broken"),
    sent("2026-06-25T08:00:07+08:00", LOADED, {"actionCode": "load", "taskGroupCode": "G7"})
    + sent("2026-06-25T08:00:08+08:00", REACH, {"stationCode": "LABOR-2", "robotCode": "robot-2"}),
]


@pytest.fixture(scope="module")
def log_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "flow-2026-06-25.000001.log").write_text("\n".join(LINES_2), encoding="utf-8")
    first = "\n".join(LINES_1).encode() + b"\n[bad \xff bytes]\n"
    (folder / "flow-2026-06-25.000000.log").write_bytes(first)
    return str(folder)


def test_entries_of_a_split_day(spark, log_files):
    entries = eventlog.read_event_log(spark, log_files, multiline=False).cache()
    # Stray text belongs to the entry before it, unless entries end with their line.
    whole = eventlog.read_event_log(spark, log_files).orderBy("row_id").collect()
    assert [r["ts"].second for r in whole] == [1, 3, 5, 6, 7, 8]
    rows = entries.orderBy("row_id").collect()
    assert [r["ts"].second for r in rows] == [1, 1, 3, 4, 5, 6, 7, 8]
    assert rows[0]["ts"] == at("08:00:01.123")
    assert {str(r["op_day"]) for r in rows} == {"2026-06-25"}
    assert [(r["label"], r["files"]) for r in eventlog.log_days(entries).collect()] == [("2026-06-25", 2)]


def test_fields_of_the_whole_payload(spark, tmp_path):
    """Read by path after Parquet: nested ones, of a foreign type, missing ones, in a message."""
    lines = [
        change("ND1", 1, route=[{"hop": 3}, {"hop": "4"}], battery=81.5),
        entry("2026-06-25T09:00:02", eventlog.BUSINESS_CHANGE, {"taskCode": "x", "data": {"message": json.dumps({"deep": {"n": 7}})}}),
        entry("2026-06-25T09:00:03", eventlog.BUSINESS_CHANGE, {"battery": "low", "data": {"message": "{no json", "route": 5}}),
    ]
    (tmp_path / "flow-2026-06-25.log").write_text("\n".join(lines))
    eventlog.read_event_log(spark, str(tmp_path), whole=True).write.parquet(str(tmp_path / "entries"))
    entries = spark.read.parquet(str(tmp_path / "entries"))
    rows = entries.orderBy("ts").select(
        eventlog.payload_field("$.data.route[1].hop", "int").alias("hop"),
        eventlog.payload_field("$.data.battery", "double").alias("battery"),
        eventlog.payload_field("$.battery", "double").alias("word"),
        eventlog.message_field("$.deep.n", "bigint").alias("n"),
    ).collect()
    assert [tuple(r) for r in rows] == [(4, 81.5, None, None), (None, None, None, 7), (None, None, None, None)]
    # Without ``whole`` the entries are as they were.
    assert "body" not in eventlog.read_event_log(spark, str(tmp_path / "flow-2026-06-25.log")).columns


def test_station_events(spark, log_files):
    out = eventlog.build_station_event(eventlog.read_event_log(spark, log_files))
    rows = [(r["event_type"], r["location_code"], r["robot_id"], r["robot_type"]) for r in out.orderBy("row_id").collect()]
    point = "LT_LABOR:POINT:1:2"
    assert rows == [
        ("arrived", point, "robot-1", "K50"), ("triggerGo", point, "robot-1", "K50"),
        ("release", point, "robot-1", "K50"), ("arrived", "LABOR-2", "robot-2", "K50"),
    ]


def test_callbacks(spark, log_files):
    out = eventlog.build_callback(eventlog.read_event_log(spark, log_files)).orderBy("row_id").collect()
    picked = [(r["action"], r["task_group"], r["location_type"], r["callback_id"], r["robot_type"]) for r in out]
    assert picked == [
        ("complete", "G1", "LABOR-1", "C5", "K50"), ("robot", "", "S", "77", "A42"),
        ("robot", "", "", "77", "K50"), ("load", "G7", "", "77", "K50"),
    ]
    assert out[0]["task_code"] == "ND1" and out[0]["container_id"] == ""


def change(task, second, **fields):
    top = {k: fields.pop(k) for k in ("containerCode", "fromLocationCode", "taskGroupCode") if k in fields}
    payload = {"taskCode": [task], **top, "data": fields}
    return entry(f"2026-06-25T09:00:{second:02d}", "BUSINESS_TASK_DATA_CHANGE", payload)


def test_lifecycle_fold(spark, tmp_path):
    lines = [
        change("ND1", 1, containerCode=["T1"], nextDestination=["LABOR-9"], assignedTime=0, completedTime="0", taskGroupCode="A"),
        change("ND1", 2, fromLocationCode="HAI-1-2-3-4", nextDestination=["LABOR-8"], assignedTime=1000, assignedRobotCode="k1"),
        change("ND1", 3, containerCode=["T2"], fromLocationCode="HAI-5-5-5-5", finalToStationCode="LABOR-3", assignedTime="2000", taskGroupCode="B"),
        change("ND1", 4, completedTime=62500, assignedRobotCode=""),
        change("ND2", 5, nextDestination=["LABOR-4"], wmsTaskCreated=500, assignedTime=2000, completedTime=9000),
        change("ND3", 6, nextDestination=["LABOR-4"], completedTime=0),
        change("ND4", 7, nextDestination=["STORE"], completedTime=5),
        change("XX5", 8, nextDestination=["LABOR-4"], completedTime=5),
    ]
    path = tmp_path / "x-2026-06-25.log"
    path.write_text("\n".join(lines))
    entries = eventlog.read_event_log(spark, str(path))
    got = {r["task_code"]: r for r in eventlog.build_lifecycle(entries).collect()}
    assert set(got) == {"ND1", "ND2"}
    one = got["ND1"]
    assert (one["container_id"], one["source_loc"], one["dest_loc"], one["task_group"], one["robot_id"]) == (
        "T2", "HAI-1-2-3-4", "LABOR-3", "A", "k1")
    assert (one["created_ts"], one["assigned_ts"], one["total_s"], one["assign_s"]) == (
        None, at("1970-01-01T00:00:02"), 60.0, None)
    # 0.5 s to 2 s is 1.5 s, half to even; the total starts at creation
    assert (got["ND2"]["assign_s"], got["ND2"]["total_s"], got["ND2"]["dest_loc"]) == (2.0, 8.0, "LABOR-4")
    shifted = eventlog.build_lifecycle(entries, zone="Asia/Shanghai").where("task_code = 'ND1'").first()
    assert shifted["assigned_ts"] == at("1970-01-01T08:00:02")


def test_payload_over_several_lines(spark, tmp_path):
    path = tmp_path / "plain.log"
    payload = {"taskCode": ["ND1"], "data": {"name": REACH, "message": json.dumps(AT_1)}}
    texts = [entry(f"2026-06-25T08:00:0{i}", "TASK_EXECUTION_CALLBACK_SENT", payload, pretty=True) for i in range(3)]
    path.write_text("\n".join(texts) + "\n")
    rows = eventlog.read_event_log(spark, str(path), multiline=True).orderBy("row_id").collect()
    assert [r["ts"].second for r in rows] == [0, 1, 2]
    assert rows[0]["label"] == "plain.log" and str(rows[0]["op_day"]) == "2026-06-25"
    with pytest.raises(ValueError):
        empty = tmp_path / "empty.log"
        empty.write_text("nothing here")
        eventlog.require_entries(eventlog.read_event_log(spark, str(empty)))


def test_odd_payloads(spark, tmp_path):
    """Text after the object, a foreign type in a field, and lines that begin like a date."""
    good = sent(T1, REACH, AT_1, taskCode=["ND1"])
    odd = [
        good + ' {"b": 2}', good + " junk }", sent(T1, REACH, AT_1, taskCode="ND1", fromLocationCode={"a": 1}),
        entry(T1, "BUSINESS_TASK_DATA_CHANGE", {"taskCode": ["ND1"], "data": {"nextDestination": "LABOR-1"}}),
        entry(T1, "OTHER", {"data": {"list": [20, 30]}}).replace("[20, 30]", "\n[20, 30]\n"),
    ]
    path = tmp_path / "odd-2026-06-25.log"
    path.write_text("\n".join(odd))
    rows = eventlog.read_event_log(spark, str(path)).orderBy("row_id").collect()
    assert [r["event"] for r in rows] == ["TASK_EXECUTION_CALLBACK_SENT", "BUSINESS_TASK_DATA_CHANGE", "OTHER"]
    assert rows[0]["payload"]["taskCode"] is None and rows[0]["payload"]["fromLocationCode"] == '{"a":1}'
    assert rows[1]["payload"]["data"]["nextDestination"] is None


def test_clock_and_midnight_of_an_undated_file(spark, tmp_path):
    def step(ts, **data):
        return entry(ts, "BUSINESS_TASK_DATA_CHANGE", {"taskCode": ["ND1"], "data": data})

    ms = 1782403140000  # 2026-06-25T15:59:00Z, 23:59 on the clock of the log
    lines = [
        step("2026-06-25T23:59:00+08:00", wmsTaskCreated=ms, nextDestination=["LABOR-1"]),
        step("2026-06-26T00:01:00+08:00", completedTime=ms + 120_000),
    ]
    path = tmp_path / "chain.log"
    path.write_text("\n".join(lines))
    task = eventlog.build_lifecycle(eventlog.read_event_log(spark, str(path))).collect()
    assert [(r["created_ts"], r["total_s"], str(r["op_day"])) for r in task] == [
        (at("2026-06-25T23:59:00"), 120.0, "2026-06-25")
    ]


def test_ingest_and_read_back(spark, log_files, tmp_path):
    t = eventlog.ingest_log(spark, log_files, str(tmp_path / "canonical"))
    cells = throughput.station_hour(t).where("completions > 0").collect()
    assert [(r["station"], r["hour"].hour, r["completions"]) for r in cells] == [("LABOR-1", 8, 1)]
    plan = throughput.station_hour(t)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.lower() and t.stage is not None
    with pytest.raises(ValueError, match="canonical"):
        tables.read_canonical(spark, str(tmp_path / "none"))


def test_several_tables_of_a_kind(spark, workbook):
    raw = {n: tables.read_table(spark, p) for n, p in workbook.items()}
    raw["again"] = raw["x"].limit(1)
    both = tables.identify(raw)["callback"]
    assert both.count() == raw["x"].count() + 1
    assert {r["source"] for r in both.select("source").distinct().collect()} == {"x", "again"}


def test_log_feeds_results(spark, log_files):
    t = eventlog.log_tables(eventlog.read_event_log(spark, log_files))
    cells = throughput.station_hour(t).where("completions > 0").collect()
    assert [(r["station"], r["hour"].hour, r["completions"]) for r in cells] == [("LABOR-1", 8, 1)]


@pytest.fixture(scope="module")
def workbook(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    cb = spark.createDataFrame(
        [("2026-06-25 08:00:00", "complete", "LABOR-1")], "`时间戳` string, `动作类型` string, `位置类型` string")
    st = spark.createDataFrame(
        [("2026-06-25 08:00:00", "arrived", "LT_LABOR:POINT:1:0", "r1", "K50"), ("bad", "arrived", "p", "r1", "K50")],
        "`时间戳` string, `事件类型` string, `位置编号` string, `机器人编号` string, `机器人类型` string")
    lc = spark.createDataFrame(
        [("ND1", "HAI-1-2-3", "LABOR-1", "2026-06-25 08:10:00", 600.0, 5.0, None, 90.0, None, -7.0)],
        "`任务编号` string, `A起始位置` string, `目标位置` string, `complete(任务完成时间)` string, `任务全程耗时(秒)` double,"
        " `分配耗时(秒)` double, `A42取箱耗时(秒)` double, `K50完成耗时(秒)` double, `拣选耗时(秒)` double, `A42转运耗时(秒)` double")
    cb.write.parquet(f"{folder}/one")
    st.write.option("header", True).csv(f"{folder}/two.csv")
    lc.write.option("ignoreNullFields", False).json(f"{folder}/three.json")
    return {"x": f"{folder}/one", "y": f"{folder}/two.csv", "z": f"{folder}/three.json"}


def test_read_tables(spark, workbook):
    t = tables.read_tables(spark, workbook)
    assert t.robot_type == "K50"
    events = t.station_event.orderBy("row_id").collect()
    assert [r["ts"] for r in events] == [at("08:00:00"), None]
    assert t.station_event.columns == [*S.STATION_EVENT.fieldNames(), "source"]
    task = t.lifecycle.first()
    assert (task["leg_s"], task["shuttle_s"], task["source_loc"], task["completed_ts"]) == (
        90.0, 0.0, "HAI-1-2-3", at("08:10:00"))
    stages = {r["stage_label"]: r["seconds"] for r in t.stage.collect()}
    assert stages == {"Allocation wait": 5.0, "K50 deliver + dwell": 90.0, "A42 - 转运": -7.0}
    assert fleet.leg_rows(t).first()["leg_s"] == 90.0
    assert set(registry.run(t, "cycle_describe")) == {"cycle_describe"}


def test_recognition(spark):
    assert tables.recognise(["动作类型", "位置类型", "事件类型"]) == "callback"
    assert tables.recognise(["事件类型"]) == "station"
    assert tables.recognise(["事件类型", "K50完成耗时(秒)"]) == "lifecycle"
    assert tables.recognise(["a"]) is None
    assert tables.leg_column(["K50完成耗时(秒)", "Z1完成耗时(秒)"], "Z1", []) == "Z1完成耗时(秒)"
    assert tables.leg_column(["K50完成耗时(秒)"], "Z1", []) == "K50完成耗时(秒)"
    assert tables.leg_column(["分配耗时(秒)"], None, ["分配耗时(秒)"]) == "分配耗时(秒)"
    assert tables.leg_column([], None, []) is None
    label = spark.range(1).select(tables.stage_label(F.lit("搬运耗时(秒)"))).first()[0]
    assert label == "搬运"


def test_names_stand_in_for_columns(spark):
    df = spark.createDataFrame([(1,)], "`事件类型` int")
    odd = spark.createDataFrame([(1,)], "a int")
    assert set(tables.identify({"回调明细": odd, "s": df})) == {"callback", "station"}
    with pytest.raises(ValueError, match="callback"):
        tables.identify({"s": df})


def test_quality(spark, workbook):
    raw = tables.identify({n: tables.read_table(spark, p) for n, p in workbook.items()})
    found = {(r["severity"], r["table"], r["check"], r["detail"]) for r in quality.check_tables(spark, raw).collect()}
    assert ("warning", "callback", "few_rows", "1") in found
    assert ("warning", "callback", "expected_column", "容器编号") in found
    assert ("warning", "lifecycle", "expected_column", "起始位置") in found
    assert not any(r[0] == "error" for r in found)
    bare = spark.createDataFrame([("x",)], "`时间戳` string")
    found = {(r["severity"], r["check"], r["detail"]) for r in quality.check_tables(spark, {"lifecycle": bare}).collect()}
    assert {("error", "missing_table", "callback"), ("error", "missing_table", "station"),
            ("error", "duration_column", "耗时"), ("error", "no_timestamps", "时间戳")} <= found


def test_sinks(spark, make_tables, tmp_path):
    t = make_tables([("08:00:00", "triggerGo", 1, "r"), ("09:00:00", "arrived", 1, "r")])
    result = throughput.station_hour(t)
    sinks.write_results({"hours": result}, str(tmp_path), fmt="parquet")
    assert (tmp_path / "hours" / "op_day=2026-06-25").is_dir()
    assert spark.read.parquet(str(tmp_path / "hours")).count() == 24
    sinks.write_raw(t, str(tmp_path), fmt="csv", by_day=False)
    assert spark.read.option("header", True).csv(str(tmp_path / "st_raw")).count() == 2
    odd = result.limit(3).withColumn("x", F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(1.5)), F.lit(1)))
    sinks.write_result(odd.coalesce(1), str(tmp_path / "j"), "json", by_day=False)
    lines = [json.loads(line) for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines()]
    assert {r["x"] for r in lines} == {None} and lines[0]["hour"].startswith("2026-06-25T")


def test_tables_object_is_lazy(spark, make_events):
    events = make_events([("08:00:00", "triggerGo", 1, "r")])
    t = Tables(events, given_type="K50")
    assert t.robot_type == "K50" and "stations" not in t.__dict__


def _touch(path, lines):
    path.write_text("\n".join(lines))


def test_incremental_ingest(spark, tmp_path, monkeypatch):
    """A second ingest parses nothing; a new file rewrites its own load only."""
    logs, folder = tmp_path / "logs", str(tmp_path / "canonical")
    logs.mkdir()
    _touch(logs / "a-2026-06-25.log", [sent("2026-06-25T08:00:00", REACH, AT_1, taskCode=["ND1"])])
    _touch(logs / "a-2026-06-26.log", [sent("2026-06-26T08:00:00", REACH, AT_1, taskCode=["ND1"])])
    # An undated file over midnight.
    _touch(logs / "night.log", [sent("2026-06-27T23:59:00", REACH, AT_1, taskCode=["ND1"]), sent("2026-06-28T00:01:00", FINISHED, AT_1, taskCode=["ND1"])])
    parsed = []
    read = eventlog.read_event_log
    monkeypatch.setattr(eventlog, "read_event_log", lambda s, paths, multiline=True: parsed.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or read(s, paths, multiline))

    def stored_days():
        t = eventlog.ingest_new(spark, str(logs), folder)
        return {(str(r["op_day"]), r["ts"].hour, r["event_type"]) for r in t.station_event.collect()}, t

    first, t = stored_days()
    assert first == {("2026-06-25", 8, "arrived"), ("2026-06-26", 8, "arrived"), ("2026-06-27", 23, "arrived"),
                     ("2026-06-27", 0, "triggerGo"), ("2026-06-27", 0, "release")}
    assert [r["seconds"] for r in pick_pairs(t.station_event).collect()] == [120.0]
    assert stored_days()[0] == first and len(parsed) == 1
    _touch(logs / "b-2026-06-26.log", [sent("2026-06-26T09:00:00", REACH, AT_1, taskCode=["ND1"])])
    stored = {p: p.stat().st_mtime_ns for p in (tmp_path / "canonical").rglob("load=2026-06-25/*.parquet")}
    assert stored_days()[0] == first | {("2026-06-26", 9, "arrived")}
    assert parsed[1:] == [["a-2026-06-26.log", "b-2026-06-26.log"]]
    assert stored and all(p.stat().st_mtime_ns == when for p, when in stored.items())


def test_checks_while_loading(spark, tmp_path):
    def stored(name, rows, columns):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    calls = [("2026-06-25 08:00:00", "load", "LABOR-1")] * 12
    callback = stored("cb", calls, ["时间戳", "动作类型", "位置类型"])
    station = stored("st", [("n/a", "arrived", "K50")] * 12, ["时间戳", "事件类型", "机器人类型"])
    paths = {"a": callback, "b": station}
    with pytest.raises(quality.BadData, match="no_timestamps") as raised:
        tables.load_tables(spark, paths, f"{tmp_path}/out")
    assert "error" in {r["severity"] for r in raised.value.issues.collect()}
    t, issues = tables.load_tables(spark, paths, f"{tmp_path}/out2", strict=False)
    assert t.callback.count() == 12 and t.lifecycle is None
    assert {r["check"] for r in issues.where("severity = 'error'").collect()} == {"no_timestamps"}
    with pytest.raises(ValueError, match="required"):
        lacking = stored("cb2", calls, ["时间戳", "动作", "位置类型"])
        tables.load_tables(spark, {"回调明细": lacking, "b": station}, f"{tmp_path}/out3")


def test_peak_day_dates_tasks_by_creation(spark, make_tables, make_callback, make_lifecycle):
    rows = [("2026-06-25T08:00:00", "arrived", 1, "r"), ("2026-06-26T08:00:00", "arrived", 1, "r")]
    calls = make_callback([{"ts": at("2026-06-25T08:00:00")}, {"ts": at("2026-06-25T09:00:00")}, {"ts": at("2026-06-26T09:00:00")}])
    tasks = make_lifecycle([
        {"task_code": "over", "created_ts": at("2026-06-25T23:59:00"), "completed_ts": at("2026-06-26T00:10:00")},
        {"task_code": "next", "created_ts": at("2026-06-26T01:00:00"), "completed_ts": at("2026-06-26T01:10:00")},
    ])
    kept = days.keep_peak_day(make_tables(rows, callback=calls, lifecycle=tasks))
    assert [r["task_code"] for r in kept.lifecycle.collect()] == ["over"]
    assert kept.station_event.count() == 1 and kept.callback.count() == 2
    alone = make_tables(rows)
    assert days.keep_peak_day(alone) is alone


def test_only_whole_objects_are_payloads(spark):
    """Text around an object, a second value, and what JSON does not allow make no entry."""
    good = ["{}", '{"taskCode":["ND1"]}  ', '{"data":5}', '{"taskCode":null,"containerCode":[1,"x",null]}', '{"a":"' + "y" * 50_000 + '"}']
    bad = ["", "5", "null", "{},", '{"a":1} x', 'x {"a":1}', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1,}', '[{"a":1}]', '{"a":1', "{'a':1}", '{"a":NaN}', '{"a":"\x01"}']
    rows = [(f"[2026-06-25T08:00:00.000+08:00][1][a][e][C][EV{i}] - {body}", "f.log", 0, i) for i, body in enumerate(good + bad)]
    lines = spark.createDataFrame(rows, "value string, file_name string, block bigint, line bigint")
    found = eventlog.parse_entries(lines).select("event", "payload.containerCode").collect()
    assert sorted(r["event"] for r in found) == [f"EV{i}" for i in range(len(good))]
    assert [r["containerCode"] for r in found if r["event"] == "EV3"] == [["1", "x", None]]


def test_payloads_of_other_events_are_not_parsed(spark):
    """A filter on the event stands below the parsing of payloads."""
    lines = spark.createDataFrame([("x", "f.log", 0, 0)], "value string, file_name string, block bigint, line bigint")
    plan = eventlog.build_lifecycle(eventlog.parse_entries(lines))._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.split("\n") if "Filter" in x or "Generate" in x]
    event = next(i for i, x in enumerate(steps) if "Filter" in x and eventlog.BUSINESS_CHANGE in x)
    parsed = [i for i, x in enumerate(steps) if "from_json" in x]
    assert parsed and max(parsed) < event and "from_json" not in steps[event]


def test_tasks_are_folded_once(spark, tmp_path, monkeypatch):
    """An ingest writes the tasks and their stages from one fold."""
    (tmp_path / "logs").mkdir()
    _touch(tmp_path / "logs" / "a-2026-06-25.log", [sent("2026-06-25T08:00:00", REACH, AT_1, taskCode=["ND1"])])
    plans = {}
    replace = eventlog._replace_loads

    def noted(df, path):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().optimizedPlan().toString()
        replace(df, path)

    monkeypatch.setattr(eventlog, "_replace_loads", noted)
    eventlog.ingest_new(spark, str(tmp_path / "logs"), str(tmp_path / "canonical"))
    assert len(plans) == 5 and not [n for n in ("lc_raw", "sg_raw") if "Aggregate" in plans[n]]


def test_lines_are_cut_where_entries_start(spark):
    """Most lines are found whole in one run; all are cut as the starts say, long ones too."""
    rnd = random.Random(2)
    bits = ["[2024-01-01T", "[", "2024", "x\n", "[2024-01-01", "é", "T"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 7))) for _ in range(300)] + ["[a" * 100_000, "[2024-01-01T" * 500]
    lines = spark.createDataFrame([(t, "f", 0, i) for i, t in enumerate(texts)], "value string, file_name string, block bigint, line bigint")
    got = {}
    for r in eventlog._chunks(lines).orderBy("line", "part").collect():
        got.setdefault(r["line"], []).append(r["chunk"])
    assert all(got[i] == re.split(r"(?!^)(?=\[\d{4}-\d{2}-\d{2}T)", t) for i, t in enumerate(texts))
    one = {r["line"] for r in lines.where(F.col("value").rlike(eventlog.ONE_CHUNK)).collect()}
    assert one == {i for i, t in enumerate(texts) if t and len(got[i]) == 1}
