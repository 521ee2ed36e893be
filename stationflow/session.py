"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a derived lookup table may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000


def get_session(app_name: str = "stationflow", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Event times carry no zone, so the session must not add one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local run may pick its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stationflow-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def written(df: DataFrame) -> DataFrame:
    """Compute a subresult once: a Parquet table in the shared checkpoint folder, read from there.

    It cuts the lineage and survives the loss of executors, and its readers prune columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/subresult-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a derived lookup table once and broadcast it only if it is small.

    The table goes to the checkpoint folder, which cuts its lineage and survives
    the loss of executors. Its rows are then counted: up to ``max_rows`` it gets
    the broadcast hint, beyond that it is joined by shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if kept.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(kept)
    return kept
