"""Connected components of a link table by contraction.

In each round every node points to its smallest neighbour, chains of pointers are
shortened, and the links are redrawn between what is left. Rounds end when no link is
left, after about log2 of the longest path. Links, labels and nodes stay distributed;
each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import cut


def _pointed(pointers: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by what its node points to, if it points anywhere."""
    to = pointers.select(F.col("node").alias("__n"), F.col("to").alias("__to"))
    return df.join(to, F.col(column) == F.col("__n"), "left").withColumn(
        column, F.coalesce("__to", column)
    ).drop("__n", "__to")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node each one reaches.

    NULL ends and self links are dropped, repeated links count once, no links give no
    rows. Nodes without a link are not listed.
    """
    edges = cut(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        nearest = both.groupBy("node").agg(F.min("to").alias("to"))
        pointers = nearest.withColumn("to", F.least("node", "to"))
        for _ in range(2):
            pointers = _pointed(pointers, pointers, "to")
        pointers = cut(pointers)
        if labels is None:
            labels = pointers.select("node", F.col("to").alias("component"))
        else:
            labels = cut(_pointed(pointers, labels, "component"))
        edges = cut(
            _pointed(pointers, _pointed(pointers, edges, "a"), "b")
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
