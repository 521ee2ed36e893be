"""Storage retrieval demand per aisle, bay and tote.

``by`` names the grouping keys; an empty list pools all days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.text import is_storage_location, storage_part
from stationflow.session import settle
from stationflow.tables import Tables

DAY = ("op_day",)
COHORTS = 20
CHUNK = 10_000
MARKS = (5, 20)


def _per_group(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Add aggregates of the whole group to each row of an aggregated table.

    They are joined back by key; without keys the table is settled first, so that
    it is not worked out again for each aggregate.
    """
    if by:
        return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), list(by))
    kept = settle(df)
    return kept.withColumns({n: kept.agg(c.alias(n)).scalar() for n, c in aggs.items()})


def storage_rows(lifecycle: DataFrame) -> DataFrame:
    """Tasks that start at a storage location, with aisle, bay and level."""
    source = F.col("source_loc")
    parts = {"aisle": 2, "bay": 3, "level": 4}
    return lifecycle.where(is_storage_location(source)).withColumns(
        {name: storage_part(source, position) for name, position in parts.items()}
    )


def aisle_demand(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Retrievals per aisle against the mean over aisles."""
    counts = storage_rows(t.lifecycle).groupBy(*by, "aisle").agg(F.count("*").alias("retrievals"))
    n, mean = F.col("retrievals"), F.col("mean_retrievals")
    level = F.when(n > mean * 1.5, "hot").when(n > mean, "above mean").otherwise("normal")
    return _per_group(counts, by, mean_retrievals=F.avg("retrievals")).withColumn("level", level)


def bay_demand(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Retrievals per aisle and bay from bay 1 on, and the p97 over used cells.

    If any code of the group is no integer, both columns become codes numbered
    from 0 by first appearance.
    """
    cells = (
        storage_rows(t.lifecycle)
        .groupBy(*by, "aisle", "bay")
        .agg(F.count("*").alias("retrievals"), F.min("row_id").alias("_first"))
        .withColumn("aisle_i", F.trim("aisle").try_cast("bigint"))
        .withColumn("bay_i", F.trim("bay").try_cast("bigint"))
    )
    readable = F.bool_and(F.col("aisle_i").isNotNull() & F.col("bay_i").isNotNull())
    cells = _per_group(cells, by, _numeric=readable)

    def code(column: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_seen")
        seen = cells.where(~F.col("_numeric")).groupBy(*by, column).agg(
            F.min("_first").alias("_seen")
        )
        return seen.select(
            *by, column, (F.row_number().over(order) - 1).cast("bigint").alias(f"_{column}_code")
        )

    coded = cells.join(code("aisle"), [*by, "aisle"], "left").join(
        code("bay"), [*by, "bay"], "left"
    )
    grid = coded.select(
        *by,
        F.coalesce("_aisle_code", "aisle_i").alias("aisle"),
        F.coalesce("_bay_code", "bay_i").alias("bay"),
        "retrievals",
    ).groupBy(*by, "aisle", "bay").agg(F.sum("retrievals").alias("retrievals"))
    shown = grid.where(F.col("bay") >= 1)
    return _per_group(shown, by, p97=F.percentile("retrievals", 0.97))


def tote_demand(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Retrievals per tote, over all tasks."""
    return (
        t.lifecycle.where(F.col("container_id").isNotNull())
        .groupBy(*by, "container_id")
        .agg(F.count("*").alias("retrievals"))
    )


def ranked_totes(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Tote list, most requested first within each group (a range-partitioned sort)."""
    return tote_demand(t, by).orderBy(*by, F.desc("retrievals"), "container_id")


def tote_totals(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    return tote_demand(t, by).groupBy(*by).agg(
        F.count("*").alias("totes"), F.sum("retrievals").alias("retrievals")
    )


def _frequencies(t: Tables, by: Sequence[str]) -> DataFrame:
    """Totes per retrieval count: k different counts need k(k+1)/2 tasks, so few rows."""
    return tote_demand(t, by).groupBy(*by, "retrievals").agg(F.count("*").alias("totes"))


def cohort_volume(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Retrievals by totes fetched exactly 1..20 times, and 21 for all above."""
    cohort = F.least("retrievals", F.lit(COHORTS + 1))
    volume = (
        _frequencies(t, by)
        .groupBy(*by, cohort.cast("int").alias("cohort"))
        .agg(F.sum(F.col("retrievals") * F.col("totes")).alias("volume"))
    )
    every = F.explode(F.sequence(F.lit(1), F.lit(COHORTS + 1)))
    grid = volume.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, every.alias("cohort"))
    return grid.join(volume, [*by, "cohort"], "left").fillna({"volume": 0})


def pareto_steps(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """One row per retrieval count, most requested first, with what lies before it."""
    down = Window.partitionBy(*by).orderBy(F.desc("retrievals"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    volume = F.col("retrievals") * F.col("totes")
    return _frequencies(t, by).withColumns(
        {
            "totes_before": F.coalesce(F.sum("totes").over(before), F.lit(0)),
            "volume_before": F.coalesce(F.sum(volume).over(before), F.lit(0)),
            "all_totes": F.sum("totes").over(group),
            "all_volume": F.sum(volume).over(group),
        }
    )


def _cum_pct(rank: Column) -> Column:
    reached = F.col("volume_before") + (rank - F.col("totes_before")) * F.col("retrievals")
    return reached / F.col("all_volume") * 100


def pareto_curve(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """A point per tote: % of totes against cumulative % of retrievals.

    Totes of one count lie on a straight line, so ranks come from the steps and
    no tote is sorted. A step is unfolded in chunks, spread over tasks.
    """
    chunks = F.sequence(F.lit(0), F.floor((F.col("totes") - 1) / CHUNK))
    first = F.col("totes_before") + F.col("_chunk") * CHUNK + 1
    last = F.least(first + CHUNK - 1, F.col("totes_before") + F.col("totes"))
    rank = F.col("rank")
    return (
        pareto_steps(t, by)
        .withColumn("_chunk", F.explode(chunks))
        .repartition(*by, "retrievals", "_chunk")
        .withColumn("rank", F.explode(F.sequence(first, last)))
        .select(
            *by,
            "rank",
            "retrievals",
            (rank / F.col("all_totes") * 100).alias("totes_pct"),
            _cum_pct(rank).alias("cum_pct"),
        )
    )


def pareto_marks(t: Tables, by: Sequence[str] = DAY) -> DataFrame:
    """Cumulative % at the top 5 % and 20 % of totes."""
    mark = F.explode(F.array(*[F.lit(m) for m in MARKS]))
    at = F.greatest(F.floor(F.col("all_totes") * F.col("mark_pct") / 100), F.lit(1))
    return (
        pareto_steps(t, by)
        .withColumn("mark_pct", mark)
        .withColumn("rank", at)
        .where(
            (F.col("rank") > F.col("totes_before"))
            & (F.col("rank") <= F.col("totes_before") + F.col("totes"))
        )
        .select(*by, "mark_pct", _cum_pct(F.col("rank")).alias("cum_pct"))
    )
