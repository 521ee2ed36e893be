"""Ordered operators that never need a whole key in one task.

A window over (key) alone puts every row of a busy robot or station into one
task. Here time is cut into blocks, the rows are dealt out once by (key, block), and
the window runs over (key, block). What an earlier block passes on is one row per
block, taken from the same exchange, moved to the next block by a window over the few
block rows of the key, and joined onto the block. The join needs no second exchange
of the rows: they are already dealt out by its keys.

Rows with a NULL key take no part.

A table that is stored by key and block (``sinks.write_clustered``) names its column of
blocks: its rows are then read where they lie, with no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.times import floor_div, to_micros

BLOCK_S = 600


def block_of(at: Column, block_s: int = BLOCK_S) -> Column:
    """Number of the block that a time lies in."""
    return floor_div(to_micros(at), block_s * 1_000_000)


def _dealt(df: DataFrame, keys: Sequence[str], at: Column, block_s: int, stored: str | None = None) -> DataFrame:
    """The one exchange of the rows; its users read all its columns, so that they can share it.

    Rows that are ``stored`` by the blocks of this column need none.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    if stored is not None:
        return df.withColumnRenamed(stored, "_block")
    return df.withColumn("_block", floor_div(at, block_s * 1_000_000)).repartition(*keys, "_block")


def _tails(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], *values: Column, stored: str | None = None
) -> DataFrame:
    """One row per block, from the exchange of the rows, or from where they are stored."""
    if stored is not None:
        return rows.groupBy(*keys, "_block").agg(*values)
    # Reading every column keeps the exchange below equal to that of the rows themselves.
    everything = F.bit_xor(F.xxhash64(*columns)).alias("_all")
    tails = rows.groupBy(*keys, "_block").agg(*values, everything)
    # Nor may the join's own conditions reach below it: they stop at generated columns.
    made = tails.select(F.inline(F.array(F.struct(*tails.columns))))
    return made.where(F.col("_all").isNotNull()).drop("_all")


def _by_block(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block")


def _in_block(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_block").orderBy(*order)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    block_s: int = BLOCK_S,
    stored: str | None = None,
) -> DataFrame:
    """Add ``prev`` = struct(values) of the row before, per ``keys`` in ``order``.

    The first order column is a timestamp and decides the block.
    """
    rows = _dealt(df, keys, to_micros(F.col(order[0])), block_s, stored)
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_seed")
    tails = _tails(rows, keys, rows.columns, last, stored=stored)
    seeds = tails.withColumn("_block", F.lead("_block").over(_by_block(keys))).where(F.col("_block").isNotNull())
    before = F.lag(F.struct(*values)).over(_in_block(keys, order))
    return (
        rows.withColumn("prev", before)
        .join(seeds, [*keys, "_block"], "left")
        .withColumn("prev", F.coalesce("prev", "_seed"))
        .drop("_block", "_seed")
    )


def run_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kind: str,
    values: Sequence[str],
    block_s: int = BLOCK_S,
    stored: str | None = None,
) -> DataFrame:
    """Add ``prev`` = struct(values) of the first row of the run that the row before belongs to.

    A run is a stretch of rows of one ``kind`` per ``keys`` in ``order``; ``values``
    include ``kind``. The first order column is a timestamp and decides the block.
    """
    rows = _dealt(df, keys, to_micros(F.col(order[0])), block_s, stored)
    window = _in_block(keys, order)
    old = F.lag(kind).over(window)
    # The first row of a block starts a run until the block before is known.
    first = F.struct(*values, old.isNull().alias("_first"))
    marked = rows.withColumn("_start", F.when(old.isNull() | (old != F.col(kind)), first))
    started = F.col("_start").isNotNull()
    tails = _tails(
        marked, keys, rows.columns,
        F.max_by("_start", F.when(started, F.struct(*order))).alias("_seed"), F.count("_start").alias("_runs"),
        stored=stored,
    )
    blocks = _by_block(keys)
    goes_on = (F.col("_runs") == 1) & (F.lag(F.col("_seed")[kind]).over(blocks) == F.col("_seed")[kind])
    own = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("_seed"))
    upto = blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeds = (
        tails.withColumn("_own", own)
        .select(*keys, F.lead("_block").over(blocks).alias("_block"), F.last("_own", ignorenulls=True).over(upto).alias("_seed"))
        .where(F.col("_block").isNotNull())
    )
    before = F.last("_start", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    prev = F.col("prev")
    from_seed = prev.isNull() | (prev["_first"] & F.coalesce(prev[kind] == F.col("_seed")[kind], F.lit(False)))
    return (
        marked.withColumn("prev", before)
        .join(seeds, [*keys, "_block"], "left")
        .withColumn("prev", F.when(from_seed, F.col("_seed")).otherwise(prev).dropFields("_first"))
        .drop("_block", "_seed", "_start")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Sequence[str],
    block_s: int = BLOCK_S,
) -> DataFrame:
    """Replace each column of ``totals`` by its running sum per ``keys``.

    The first order column holds microseconds and decides the block.
    """
    rows = _dealt(df, keys, F.col(order[0]), block_s)
    tails = _tails(rows, keys, rows.columns, *[F.sum(c).alias(f"_{c}") for c in totals])
    earlier = _by_block(keys).rowsBetween(Window.unboundedPreceding, -1)
    seeds = tails.select(*keys, "_block", *[F.sum(f"_{c}").over(earlier).alias(f"_{c}") for c in totals])
    upto = _in_block(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({c: F.sum(c).over(upto) for c in totals}).join(seeds, [*keys, "_block"], "left")
    zero = F.lit(0)
    return within.withColumns({c: F.col(c) + F.coalesce(f"_{c}", zero) for c in totals}).drop(
        "_block", *[f"_{c}" for c in totals]
    )
