"""Subresults that several results read."""

import pytest
from pyspark.sql import functions as F

from checks import adapters
from checks.compare import difference
from checks.queries import tidy
from stationflow.plans import registry
from stationflow.tables import Tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Made-up days as stored tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    ev = spark.range(4000).select(
        F.col("id").alias("event_id"),
        (F.lit("2026-06-25 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 43)).alias("ts"),
        (F.hash("id") % 7).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "purchase", "view", "signup"))), F.pmod(F.hash("id", F.lit(1)), F.lit(4)) + 1).alias("event_type"),
        (F.pmod(F.hash("id", F.lit(2)), F.lit(40000)) / 100).alias("value"),
        F.pmod(F.hash("id", F.lit(3)), F.lit(97)).cast("int").alias("k"),
    ).withColumns({"op_day": F.to_date("ts"), "user_id": F.abs("user_id")})
    for name in ("station_event", "callback", "lifecycle", "stage_rows"):
        getattr(adapters, name)(ev).write.parquet(f"{folder}/{name}")
    return lambda: Tables(*(spark.read.parquet(f"{folder}/{n}") for n in ("station_event", "callback", "lifecycle", "stage_rows")))


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_all_results_share_the_events(stored):
    """The events are read for the stations, the day types and the shared table, and never again."""
    found = registry.run(stored())
    assert set(found) == set(registry.RESULTS)
    assert not [name for name, df in found.items() if "/station_event" in plan(df)]


def test_few_leaves(stored):
    for name in ("throughput_detail", "fleet_timeline", "utilisation_chain", "fleet_summary"):
        lines = plan(registry.run(stored(), name)[name]).split("\n")
        assert len([x for x in lines if "Scan " in x or "Scan[" in x]) <= 4, name


def test_sharing_changes_no_result(stored):
    names = ("throughput_station_hour", "pick_station_hour", "occupancy", "daily_stats", "queue_depth", "depth_box", "leg_describe", "fleet_active_robots")
    shared, tables = registry.run(stored(), *names), stored()
    for name in names:
        alone = registry.RESULTS[name][1](tables)
        assert difference(tidy(shared[name]).toPandas(), tidy(alone).toPandas()) is None, name


def test_a_subresult_is_built_once(stored):
    t, built = stored(), []

    def build():
        built.append(1)
        return t.station_event.limit(1)

    assert t.found("x") is None
    assert t.kept("x", build) is t.kept("x", build) is t.found("x") and built == [1]
    assert t.only(t.station_event.select("op_day").distinct()).found("x") is None


def test_results_in_sql(spark, stored):
    """Views equal their results, and a day asked for reaches the scan."""
    t = stored()
    assert registry.create_views(t, "cycle_summary", "retrieval_aisle", prefix="v_") == ["v_cycle_summary", "v_retrieval_aisle"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    day = t.lifecycle.agg(F.max("op_day")).first()[0]
    asked = spark.sql("SELECT * FROM v_cycle_summary WHERE op_day = :day", args={"day": day})
    whole = registry.RESULTS["cycle_summary"][1](t)
    assert difference(asked.toPandas(), whole.where(F.col("op_day") == day).toPandas()) is None
    scans = [x for x in plan(asked).split("\n") if "/lifecycle" in x]
    assert scans and all("EqualTo(op_day," in x for x in scans)
