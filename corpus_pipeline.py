"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the documents of the next stage. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import mixing, packing, pii, prefix_join, quality_ledger
from stationflow.llm.common import shared_folder, table
from stationflow.session import settle

# Ids that are broadcast as a set, 16 bytes each; more are joined by shuffle.
MOST_IDS = 2_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Several stages train or pack by rules that SQL does not express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_ledger.decide(quality_ledger.ledger(docs, keep=COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    found = prefix_join.linked_components(docs)
    gone = settle(found.where("component_id <> doc_id").select("doc_id").distinct(), MOST_IDS)
    # Texts stay where they are, but for those of ids that stand more than once.
    ids = docs.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    repeated = settle(ids, MOST_IDS)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    once = docs.join(repeated, same, "left_anti")
    more = docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets."""
    found = pii.find_spans(docs, keep=COLUMNS)
    clean = found.withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say; no domain is drawn up to its target by copies."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), at_most=True).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
