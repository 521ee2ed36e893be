import random
from datetime import timedelta

from conftest import DAY, at
from pyspark.sql import functions as F

from stationflow.operators.overlap import overlap_count
from stationflow.operators.pairing import dwell_pairs, pair_events, pick_pairs, switch_pairs
from stationflow.plans import dwell, switch, throughput
from stationflow.sources.sinks import write_clustered
from stationflow.tables import Tables


def spans(df):
    return sorted(
        (r["start_ts"].strftime("%H:%M:%S"), r["end_ts"].strftime("%H:%M:%S")) for r in df.collect()
    )


def test_later_arrival_replaces_open_one(make_events):
    ev = make_events(
        [("00:00:01", "arrived", 1, "r"), ("00:00:05", "arrived", 2, "r"),
         ("00:00:09", "triggerGo", 1, "r"), ("00:00:12", "triggerGo", 1, "r")]
    )
    assert spans(pick_pairs(ev)) == [("00:00:05", "00:00:09")]
    assert pick_pairs(ev).first()["location_code"] == "LT_LABOR:POINT:2:0"


def test_first_open_arrival_stays_open(make_events):
    ev = make_events(
        [("00:00:01", "arrived", 1, "r"), ("00:00:05", "arrived", 1, "r"),
         ("00:00:09", "release", 1, "r"), ("00:00:12", "release", 1, "r")]
    )
    assert spans(dwell_pairs(ev)) == [("00:00:01", "00:00:09")]


def test_switch_takes_any_robot_and_ties_leave_picks_alone(make_events):
    ev = make_events(
        [("00:00:02", "arrived", 1, "r1"), ("00:00:10", "triggerGo", 1, "r1"),
         ("00:00:10", "release", 1, "r1"), ("00:00:14", "arrived", 1, "r2")]
    )
    assert spans(pick_pairs(ev)) == [("00:00:02", "00:00:10")]
    pairs = switch_pairs(ev, "location_code")
    assert spans(pairs) == [("00:00:10", "00:00:14")]
    assert pairs.first()["seconds"] == 4.0


def test_bounds(make_tables):
    t = make_tables(
        [("08:00:00", "arrived", 1, "a"), ("08:00:00", "triggerGo", 1, "a"),
         ("09:00:00", "arrived", 1, "a"), ("10:00:00", "triggerGo", 1, "a"),
         ("11:00:00", "release", 2, "b"), ("11:00:00", "arrived", 2, "b"),
         ("12:00:00", "release", 2, "b"), ("14:00:00", "arrived", 2, "b")]
    )
    assert [r["pick_s"] for r in dwell.pick_intervals(t).collect()] == [0.0]
    assert throughput.valid_picks(t).count() == 0
    assert [r["switch_s"] for r in switch.switch_intervals(t).collect()] == [0.0]


def test_null_keys_and_times_never_pair(spark, make_events):
    ev = make_events(
        [("00:00:01", "arrived", 1, None), ("00:00:03", "triggerGo", 1, None),
         ("00:00:05", "arrived", 1, "r"), ("00:00:07", "triggerGo", 1, "r")]
    ).withColumn("ts", F.when(F.second("ts") != 5, F.col("ts")))
    assert pick_pairs(ev).count() == 0


def naive(rows, opener, closer, first_open):
    open_ts, out = None, []
    for ts, event in rows:
        if event == opener and (open_ts is None or not first_open):
            open_ts = ts
        elif event == closer and open_ts is not None:
            out.append((open_ts, ts))
            open_ts = None
    return out


def test_pairs_equal_a_state_machine(spark, make_events):
    """Random streams with ties, over many blocks and with empty blocks."""
    rng = random.Random(7)
    rows, t = [], at("00:00:00")
    for _ in range(900):
        t += timedelta(seconds=rng.choice([0, 0, 1, 5, 40, 400]))
        rows.append((t, rng.choice(["arrived", "triggerGo", "release", "other"]), 1, rng.choice("abc")))
    ev = make_events(rows).cache()
    for opener, closer, mode in [
        ("arrived", "triggerGo", "last_open"),
        ("release", "arrived", "last_open"),
        ("arrived", "release", "first_open"),
    ]:
        got = pair_events(ev, ["op_day", "robot_id"], opener, closer, mode=mode, block_s=60)
        got = sorted((r["robot_id"], r["start_ts"], r["end_ts"]) for r in got.collect())
        want = sorted(
            (robot, a, b)
            for robot in "abc"
            for a, b in naive(
                [(ts, e) for ts, e, _, r in rows if r == robot], opener, closer, mode == "first_open"
            )
        )
        assert got == want, mode
    assert DAY == ev.first()["op_day"]


def test_no_task_holds_a_whole_hot_key(spark, make_events):
    """One robot has every event: its windows still run over many small groups."""
    rows = [(at("00:00:00") + timedelta(seconds=20 * i), "arrived" if i % 2 else "triggerGo", 1, "r")
            for i in range(2000)]
    plan = pick_pairs(make_events(rows))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [lag" in line]
    assert windows and all("_block" in line for line in windows)


def _exchanges(df):
    """Leaf scans, and exchanges that are planned anew, of the static plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [x for x in lines if "Scan " in x or "Scan[" in x]
    return len(scans), len([x for x in lines if "REPARTITION_BY_COL" in x and "Reused" not in x]), len([x for x in lines if "ReusedExchange" in x])


def test_rows_are_read_and_dealt_out_once(spark, tmp_path, make_events):
    """One scan and one exchange of the rows serve both the window and the block tails."""
    make_events([("00:00:01", "arrived", 1, "r")]).drop("row_id").withColumn("row_id", F.lit(1)).write.parquet(f"{tmp_path}/e")
    ev = spark.read.parquet(f"{tmp_path}/e")
    for pairs in (pick_pairs(ev), switch_pairs(ev, "location_code"), dwell_pairs(ev)):
        assert _exchanges(pairs) == (1, 1, 1)
    rows = ev.select("location_code", "row_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("e"))
    assert _exchanges(overlap_count(rows, ["location_code"], "row_id", "s", "e")) == (1, 1, 1)


def test_a_busy_robot_is_spread(spark, make_events):
    """A third of all rows belong to one robot; no task gets much more than its share of them."""
    rows = [(f"{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}", "arrived" if k // 12 % 2 == 0 else "triggerGo", 1, "busy" if k % 3 == 0 else f"r{k}") for k in range(0, 80_000, 4)]
    dealt = pick_pairs(make_events(rows)).where("robot_id = 'busy'").groupBy(F.spark_partition_id().alias("p")).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in dealt.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(counts) > 1 and max(counts) < 0.6 * sum(counts)


def test_runs_over_many_blocks(make_events):
    """A run that fills whole blocks keeps its first row."""
    ev = make_events(
        [("00:00:01", "release", 1, "r"), ("00:00:02", "arrived", 1, "r"), *[(f"{h:02d}:00:00", "arrived", h, "r") for h in range(1, 9)],
         ("09:00:00", "release", 1, "r"), ("09:30:00", "release", 1, "r"), ("12:00:00", "arrived", 1, "r"), ("15:00:00", "release", 1, "r")]
    )
    assert spans(dwell_pairs(ev)) == [("00:00:02", "09:00:00"), ("12:00:00", "15:00:00")]


def _clustered(spark, tmp_path, events, buckets=4):
    name = f"stored_{abs(hash(str(tmp_path)))}"
    return write_clustered(events, name, f"{tmp_path}/clustered", buckets)


def test_stored_events_pair_where_they_lie(spark, tmp_path, make_events):
    """Same pairs as from the plain table; only the block tails are dealt out."""
    rng = random.Random(5)
    kinds = ["arrived", "triggerGo", "release"]
    rows = [(at("00:00:00") + timedelta(seconds=rng.randrange(86_000)), rng.choice(kinds), rng.randrange(3), rng.choice(["busy", "busy", "r", None]))
            for _ in range(3000)]
    plain = make_events(rows)
    stored = _clustered(spark, tmp_path, plain)
    for pairs in (pick_pairs, dwell_pairs):
        assert sorted(map(str, pairs(stored).collect())) == sorted(map(str, pairs(plain).collect()))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = pairs(stored)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert len(moved) == 1 and "event_type" not in moved[0] and "REPARTITION" not in plan, plan
        # A robot with most of the rows lies in every bucket.
    assert stored.where("robot_id = 'busy'").select(F.spark_partition_id()).distinct().count() == 4


def test_stored_events_without_times_or_robots(spark, tmp_path, make_events):
    """They are kept, spread over the buckets, and pair with nothing."""
    rows = [("00:00:01", "arrived", 1, None), ("00:00:03", "triggerGo", 1, None), ("00:00:04", "arrived", 1, "r")]
    timeless = make_events(rows * 40).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    stored = _clustered(spark, tmp_path, make_events(rows).unionByName(timeless))
    assert stored.count() == 123 and pick_pairs(stored).count() == 0
    assert stored.where("ts IS NULL").select(F.spark_partition_id()).distinct().count() == 4
    empty = write_clustered(timeless.limit(0), "stored_empty", f"{tmp_path}/empty", 2)
    assert pick_pairs(empty).count() == 0 and dwell_pairs(empty).count() == 0


def test_results_of_stored_events(spark, tmp_path, make_events):
    """A result over tables with stored events equals that over plain ones, shared or alone."""
    rows = [(at("08:00:00") + timedelta(seconds=50 * i), ("arrived", "triggerGo", "release")[i % 3], i % 2 + 1, "ab"[i % 5 > 2]) for i in range(400)]
    plain = make_events(rows)
    stored = _clustered(spark, tmp_path, plain)
    want = sorted(map(str, dwell.pick_intervals(Tables(plain, given_type="AMR")).collect()))
    t = Tables(stored, given_type="AMR")
    assert sorted(map(str, dwell.pick_intervals(t).select(dwell.pick_intervals(Tables(plain, given_type="AMR")).columns).collect())) == want
    assert "ts_block" not in t.share_events().columns
