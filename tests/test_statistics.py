import random
from datetime import date

import numpy as np
import pytest
from conftest import DAY, at
from pyspark.sql import functions as F

from stationflow.functions import stats
from stationflow.operators import quantiles
from stationflow.operators.quantiles import exact_quantiles
from stationflow.plans import cycle, fleet, summary
from stationflow.tables import Tables


def test_quantiles_equal_numpy(spark):
    """Groups of very different size, ties, negative values and NULLs."""
    rng = random.Random(5)
    groups = {"hot": 4000, "few": 3, "one": 1, "even": 10}
    rows = [
        (g, rng.choice([round(rng.uniform(-50, 400), 3), 7.0, None])) for g, n in groups.items()
        for _ in range(n)
    ] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    named = {"lo": 0.0, "p10": 0.1, "med": 0.5, "p99": 0.99, "hi": 1.0}
    for bucket in (1.0, 1000.0, 0.01, None):
        out = exact_quantiles(df, ["g"], "v", named, bucket, count="n", mean="m").collect()
        for r in out:
            v = np.array([x for g, x in rows if g == r["g"] and x is not None])
            assert r["n"] == len(v) and np.isclose(r["m"], v.mean())
            assert np.allclose([r[k] for k in named], np.percentile(v, [100 * p for p in named.values()]))
    pooled = exact_quantiles(df, [], "v", {"med": 0.5}).collect()
    assert np.isclose(pooled[0]["med"], np.median([x for _, x in rows if x is not None]))


def test_cuts_split_any_spread_evenly(spark):
    """A narrow range far from 0, one value that half the rows have, and a long tail."""
    n = 6400
    near = spark.range(n).select(F.lit("near").alias("g"), (F.lit(1e6) + F.col("id") * 0.1 / n).alias("_value"))
    tail = spark.range(n).select(F.lit("tail"), F.exp(F.col("id") * 40.0 / n))
    counts = near.union(tail).withColumn("_n", F.lit(1)).union(spark.sql("SELECT 'tail', -5.0D, 6400"))
    sizes = quantiles._between_cuts(counts, ["g"]).groupBy("g", "_bucket").count().collect()
    assert len(sizes) > 2 * quantiles.CUTS and max(r["count"] for r in sizes) < 3 * n / quantiles.CUTS


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5), (4.0, 2), (9.0, 1), (7.0, 0)], "v double, n long")
    r = exact_quantiles(df, [], "v", {"med": 0.5, "p80": 0.8}, count="c", mean="m", weight="n").first()
    rows = [1.0] * 5 + [4.0] * 2 + [9.0]
    assert (r["c"], r["m"], r["med"], r["p80"]) == pytest.approx(
        (8, np.mean(rows), np.median(rows), np.percentile(rows, 80)))


def test_guarded_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 6.0, 5.0)], "x double, y double, c double")
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    r = df.select(
        stats.corr(x, y).alias("r"), stats.corr(x, c).alias("rc"), stats.slope(x, c).alias("sc"),
        stats.r_squared(x, c).alias("r2c"), stats.r_squared(x, y).alias("r2"),
        stats.slope(c, x).alias("none"),
    ).first()
    assert r["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 6])[0, 1])
    assert (r["rc"], r["sc"], r["r2c"], r["none"]) == (None, 0.0, None, None)
    assert r["r2"] == pytest.approx(r["r"] ** 2)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 3.0)], "g int, v double")
    ranks = df.select("v", cycle.average_rank("v", ["g"]).alias("rank")).collect()
    assert sorted(r["rank"] for r in ranks) == [1.0, 2.5, 2.5, 4.0]


def test_consistency(make_callback):
    rows = [
        {"ts": at(f"{hour:02d}:{i:02d}:00"), "action": "complete", "location_type": "LABOR-1"}
        for hour, n in ((8, 2), (9, 4), (10, 6)) for i in range(n)
    ]
    r = summary.hourly_consistency(Tables(callback=make_callback(rows))).first()
    assert (r["hours"], r["cv"], r["peak_to_mean"]) == (3, 0.5, 1.5)


def test_day_changes(spark, monkeypatch):
    """100 -> 80 tasks is worse, 10 -> 8 s pick is better; from 0 there is no change."""
    days = [(date(2026, 1, d),) + v for d, v in ((1, (100, 4.0, 0.0, 10.0)), (2, (80, 4.0, 5.0, 8.0)),
                                                  (3, (80, 4.0, 0.0, 8.0)))]
    df = spark.createDataFrame(
        days, "op_day date, total_tasks long, median_cycle_min double, p90_cycle_min double,"
        " mean_pick_s double"
    ).withColumn("median_switch_s", F.lit(None).cast("double"))
    monkeypatch.setattr(summary, "daily_stats", lambda t: df)
    got = {(r["metric"], r["op_day"].day): (r["change_pct"], r["improvement_pct"], r["scale_pct"])
           for r in summary.day_changes(None).collect()}
    assert got["total_tasks", 2] == pytest.approx((-20.0, -20.0, 100.0))
    assert got["mean_pick_s", 2] == pytest.approx((-20.0, 20.0, 100.0))
    assert got["p90_cycle_min", 2][:2] == (None, None)
    assert got["p90_cycle_min", 3][0] == -100.0
    assert not any(metric == "median_switch_s" for metric, _ in got)
    assert summary.headline_trend(None).count() == 3
    monkeypatch.setattr(summary, "daily_stats", lambda t: df.limit(1))
    assert summary.headline_trend(None).count() == 0


def test_cycle_histogram_keeps_long_tasks(make_lifecycle):
    rows = [{"total_s": s, "completed_ts": at("08:00:00")} for s in (0.0, 29.9, 30.0, 1800.0, 5000.0, 7200.0)]
    bins = {r["bin"]: r["tasks"] for r in cycle.cycle_histogram(Tables(lifecycle=make_lifecycle(rows))).collect()}
    assert len(bins) == 60 and bins[0] == 2 and bins[1] == 1 and bins[59] == 2 and sum(bins.values()) == 5


def test_depth_bins(spark):
    def edges(values):
        df = spark.createDataFrame([(DAY, v, 1) for v in values], "op_day date, depth long, n long")
        return fleet.depth_edges(df).first()["edges"]

    assert edges([3, 3, 3]) == [1, 4]
    assert edges([1] * 10) == [1, 2]
    assert edges(range(1, 12)) == [1, 3, 5, 7, 9, 11]
    assert edges([1, 1, 1, 1, 2, 2, 4, 9]) == [1, 2, 3, 9]


def test_leg_by_depth_labels(make_lifecycle):
    """Constant depth makes one bin; stacked deliveries fill several."""
    lone = [{"leg_s": 60.0, "dest_loc": "LABOR-1", "completed_ts": at(f"{h:02d}:00:00")} for h in range(1, 6)]
    out = fleet.leg_by_depth(Tables(lifecycle=make_lifecycle(lone))).collect()
    assert [(r["label"], r["deliveries"], r["median_leg_s"]) for r in out] == [("<2", 5, 60.0)]


def test_fleet_falls_back_to_station_intervals(make_tables, make_lifecycle):
    """Day without lifecycle rows: robot dwell; a fleet without pairs: robot spans."""
    events = [
        ("08:00:00", "arrived", 1, "k"), ("08:20:00", "release", 1, "k"),
        ("08:05:00", "other", 1, "s", "A42"), ("08:25:00", "other", 1, "s", "A42"),
    ]
    t = make_tables(events)
    spans = {r["fleet"]: (r["start_ts"], r["end_ts"]) for r in fleet.task_intervals(t).collect()}
    assert spans == {
        "delivery": (at("08:00:00"), at("08:20:00")), "shuttle": (at("08:05:00"), at("08:25:00"))
    }
    rows = [{"leg_s": 300.0, "shuttle_s": 60.0, "completed_ts": at("08:10:00"), "dest_loc": "LABOR-1"}] * 3
    full = make_tables(events, lifecycle=make_lifecycle(rows))
    timeline = {(r["fleet"], r["mid_ts"]): r for r in fleet.fleet_timeline(full).collect()}
    busy = timeline["delivery", at("08:07:30")]
    assert (busy["on_task"], busy["fleet_size"], busy["utilisation_pct"]) == (1, 1, 100.0)
    assert len(timeline) == 10
