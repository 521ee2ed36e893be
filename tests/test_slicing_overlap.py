import random
from datetime import timedelta

from conftest import DAY, at
from pyspark.sql import functions as F

from stationflow.operators.overlap import active_at, bin_span, overlap_count
from stationflow.operators.slicing import occupied_seconds, slice_hours
from stationflow.plans import dwell, throughput


def intervals(spark, rows, extra="station"):
    data = [(DAY, key, i, at(a), at(b)) for i, (key, a, b) in enumerate(rows)]
    return spark.createDataFrame(
        data, f"op_day date, {extra} string, id long, start_ts timestamp_ntz, end_ts timestamp_ntz"
    )


def test_hour_slices(spark):
    iv = intervals(
        spark,
        [("a", "10:55:00", "11:03:00"), ("b", "04:59:50", "05:00:10"), ("c", "11:55:00", "12:40:00"),
         ("d", "07:00:00", "07:00:00"), ("e", "06:30:00", "07:00:00")],
    )
    got = {(r["station"], r["hour"].hour): (r["slice_s"], r["frac"]) for r in slice_hours(iv).collect()}
    assert got == {
        ("a", 10): (300.0, 0.625), ("a", 11): (180.0, 0.375),
        ("b", 4): (10.0, 0.5), ("b", 5): (10.0, 0.5),
        ("c", 11): (300.0, 300 / 2700), ("c", 12): (2400.0, 2400 / 2700),
        ("d", 7): (0.0, None), ("e", 6): (1800.0, 1.0),
    }


def test_cells_never_exceed_an_hour(spark):
    iv = intervals(spark, [("a", "10:00:00", "11:30:00"), ("a", "10:10:00", "10:50:00")])
    got = {r["hour"].hour: r["occupied_s"] for r in occupied_seconds(iv, ["op_day", "station"]).collect()}
    assert got == {10: 3600.0, 11: 1800.0}


def test_slices_add_up(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        a = at("00:00:00") + timedelta(microseconds=rng.randrange(70_000_000_000))
        rows.append((DAY, "s", i, a, a + timedelta(microseconds=rng.randrange(9_000_000_000))))
    iv = spark.createDataFrame(
        rows, "op_day date, station string, id long, start_ts timestamp_ntz, end_ts timestamp_ntz"
    )
    sums = slice_hours(iv).groupBy("id").agg(F.sum("slice_s").alias("s"), F.sum("frac").alias("f"))
    for r in sums.collect():
        start, end = rows[r["id"]][3:]
        assert abs(r["s"] - (end - start).total_seconds()) < 1e-6 and abs(r["f"] - 1) < 1e-9


def test_overlap_ends_are_closed(spark):
    iv = intervals(
        spark,
        [("a", "00:00:00", "00:00:10"), ("a", "00:00:10", "00:00:20"), ("a", "00:00:21", "00:00:30"),
         ("b", "00:00:00", "00:01:00")],
    )
    out = overlap_count(iv, ["op_day", "station"], "id", "start_ts", "end_ts")
    assert {r["id"]: r["depth"] for r in out.collect()} == {0: 2, 1: 2, 2: 1, 3: 1}
    assert set(out.columns) == {"op_day", "station", "id", "start_ts", "end_ts", "depth"}


def test_overlap_and_stabbing_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a = at("00:00:00") + timedelta(seconds=rng.randrange(0, 40_000, 5))
        rows.append((DAY, rng.choice("ab"), i, a, a + timedelta(seconds=rng.randrange(0, 3000, 5))))
    iv = spark.createDataFrame(
        rows, "op_day date, fleet string, id long, start_ts timestamp_ntz, end_ts timestamp_ntz"
    ).cache()
    depth = overlap_count(iv, ["op_day", "fleet"], "id", "start_ts", "end_ts", block_s=120)
    got = {r["id"]: r["depth"] for r in depth.collect()}
    for _, key, i, s, e in rows:
        assert got[i] == sum(k == key and a <= e and b >= s for _, k, _, a, b in rows)

    grid = bin_span(iv.select("op_day", "fleet", F.col("start_ts").alias("ts")), ["op_day", "fleet"])
    active = active_at(iv, ["op_day", "fleet"], grid, "start_ts", "end_ts").collect()
    assert active
    for r in active:
        want = sum(k == r["fleet"] and a <= r["mid_ts"] <= b for _, k, _, a, b in rows)
        assert r["active"] == want


def test_interval_that_ends_on_a_midpoint_counts(spark):
    iv = intervals(spark, [("x", "00:01:00", "00:02:30"), ("x", "00:07:30", "00:09:00")], "fleet")
    grid = spark.createDataFrame([(DAY, "x", at("00:00:00")), (DAY, "x", at("00:15:00"))],
                                 "op_day date, fleet string, ts timestamp_ntz")
    out = active_at(iv, ["op_day", "fleet"], bin_span(grid, ["op_day", "fleet"]), "start_ts", "end_ts")
    assert [r["active"] for r in out.orderBy("mid_ts").collect()] == [1, 1, 0]


def test_effective_tasks_and_midnight(make_tables):
    """A pick over midnight keeps only its first slice in the 24-hour grid."""
    t = make_tables(
        [("10:55:00", "arrived", 1, "r"), ("11:03:00", "triggerGo", 1, "r"),
         ("23:59:50", "arrived", 1, "r"), ("2026-06-26T00:00:10", "triggerGo", 1, "r")]
    )
    cells = {r["hour"].hour: r for r in throughput.station_hour_detail(t).collect()}
    assert len(cells) == 24
    assert cells[11]["effective_tasks"] == 0.375
    assert cells[10]["effective_tasks"] is None  # no completion in that hour
    assert abs(cells[23]["active_pct"] - 10 / 36) < 1e-9
    ungridded = {r["hour"]: r["mean_s"] for r in dwell.pick_station_hour(t).collect()}
    assert ungridded[at("23:00:00")] == 10.0
    assert ungridded[at("2026-06-26T00:00:00")] == 10.0
    assert at("2026-06-26T00:00:00") not in {r["hour"] for r in dwell.weighted_pick(t).collect()}


def test_picker_rate(make_tables):
    rows = [(at("00:00:30") + timedelta(minutes=i), "triggerGo", 1, "r") for i in range(20)]
    rate = throughput.picker_rate(make_tables(rows)).orderBy("minute").collect()
    assert len(rate) == 1440
    assert [r["rate_tph"] for r in rate[:9]] == [None] * 9
    assert {r["rate_tph"] for r in rate[9:20]} == {60.0}
    assert rate[29]["rate_tph"] == 0.0
