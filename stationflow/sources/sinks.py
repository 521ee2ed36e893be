"""Writers for results and canonical tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.stats import finite
from stationflow.operators.ordered import block_of
from stationflow.tables import Tables

def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL; times are written as ISO text."""
    numbers = [n for n, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({n: finite(F.col(n)) for n in numbers}) if numbers else df


def write_result(
    df: DataFrame, path: str, fmt: str = "parquet", by_day: bool = True, mode: str = "errorifexists"
) -> None:
    """Write one result, a folder per ``op_day`` if it has that column.

    Rows are dealt by day before they are written: a small day is one file, and a large
    one is split by its size.
    """
    out = json_safe(df) if fmt == "json" else df
    if by_day and "op_day" in df.columns:
        out = out.hint("rebalance", "op_day")
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    if by_day and "op_day" in df.columns:
        writer = writer.partitionBy("op_day")
    writer.save(path)


def write_results(results: Mapping[str, DataFrame], folder: str, **options) -> None:
    for name, df in results.items():
        write_result(df, f"{folder}/{name}", **options)


def write_raw(t: Tables, folder: str, **options) -> None:
    """The canonical tables as they are."""
    tables = {out: getattr(t, name) for name, out in S.RAW_NAMES.items()}
    write_results({n: df for n, df in tables.items() if df is not None}, folder, **options)


# Parts of a day that rows without a time are spread over.
TIMELESS_PARTS = 1024


def write_clustered(
    events: DataFrame, table: str, path: str, buckets: int | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Store station events by (day, robot, block of time) and give them as a table of the catalog.

    ``pick_pairs`` and ``dwell_pairs`` over the table, or over joins that keep its rows in
    place, move no rows: their windows find each block in one bucket. A robot with a third
    of all rows is spread over the buckets by its blocks. ``buckets`` is the number of tasks
    that will read the table (the session's shuffle partitions unless given); each is one
    file. Rows without a time, which no pair holds, are spread by their content.
    """
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timeless = -1 - F.pmod(F.xxhash64(*events.columns), F.lit(TIMELESS_PARTS))
    keys = [*S.ROBOT_DAY, S.TS_BLOCK]
    rows = events.withColumn(S.TS_BLOCK, F.coalesce(block_of(F.col("ts")), timeless))
    # Dealt out as the buckets are, so that each bucket is one file and one task writes it.
    dealt = rows.repartition(buckets, *keys)
    writer = dealt.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys, "ts")
    writer.option("path", path).saveAsTable(table)
    return spark.table(table)
