"""Licence scan by canonical digest: whole texts, and whole lines as notices.

A text is brought to one canonical form (lower case, no copyright lines, no
punctuation, one spelling for words that are spelled in more ways, single spaces), and
its SHA-256 is joined with the digests of known texts, which go through the same form.
The known table is a fixed list (a few dozen rows), so it is broadcast, and documents
are not shuffled; ``scan`` also takes a further table of known texts and notices.

``license_id`` is the licence whose text is the whole document; ``notice_ids`` lists
the licences whose notice stands as a whole line in it, or, for a given notice of
several lines, as that many whole lines in a row. Of licences with one digest the first
by name is told.

Defined results: a NULL or empty text, or one with nothing left in canonical form, has
no licence and no notice; repeated rows are judged one by one; a NULL doc_id is kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.license_texts import NOTICES, TEXTS

# Spellings that count as equal, as whole words after punctuation is gone. Fixed values.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("per cent", "percent"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"),
)
_COPYRIGHT = r"(?md)^[ \t>*#/-]*(copyright|\(c\)|©)[^\n]*$"
_RESERVED = r"(?md)^[ \t>*#/-]*all rights reserved\.?[ \t]*$"


def canonical(text: Column) -> Column:
    form = F.lower(F.regexp_replace(text, "\r\n?", "\n"))
    for pattern in (_COPYRIGHT, _RESERVED):
        form = F.regexp_replace(form, pattern, "")
    return _plain(form)


def _plain(form: Column) -> Column:
    form = F.concat(F.lit(" "), F.regexp_replace(form, r"[^a-z0-9]+", " "), F.lit(" "))
    for other, usual in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(form, " +", " "))


def listed(spark: SparkSession) -> DataFrame:
    """(license, text, whole) of the listed texts and notices."""
    rows = [(name, text, True) for name, text in TEXTS.items()] + [
        (name, text, False) for name, texts in NOTICES.items() for text in texts
    ]
    return spark.createDataFrame(rows, "license string, text string, whole boolean")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, whole, lines, license) of known texts; those with nothing in canonical form are left out."""
    form = F.regexp_replace(F.trim("text"), "\r\n?", "\n")
    lines = F.when(F.col("whole"), 0).otherwise(F.size(F.split(F.btrim(form, F.lit("\n ")), "\n", -1)))
    return (
        known.where((F.length(canonical(F.col("text"))) > 0) & F.col("license").isNotNull() & F.col("whole").isNotNull())
        .groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest"), "whole", lines.alias("lines"))
        .agg(F.min("license").alias("license"))
    )


def _groups(text: Column, size: int) -> Column:
    """Every ``size`` lines in a row."""
    lines = F.split(text, "\n", -1)
    if size == 1:
        return lines

    def groups(ls: Column) -> Column:
        places = F.when(F.size(ls) >= size, F.sequence(F.lit(1), F.size(ls) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(ls, i, size), "\n"))

    # Bound as a lambda's variable, so that the text is split once and not for every place.
    return F.flatten(F.transform(F.array(lines), groups))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, canonical_sha256, license_id, notice_ids.

    ``known`` (license, text, whole) adds to the listed texts and notices.
    """
    spark = docs.sparkSession
    table = listed(spark)
    if known is not None:
        table = table.unionByName(known.select("license", "text", "whole"))
    digests = known_digests(table)
    texts = (
        digests.where("whole").select(F.col("digest").alias("canonical_sha256"), F.col("license").alias("license_id"))
    )
    texts = F.broadcast(texts) if known is None else texts
    # The notices become constant maps by number of lines: digest to licence.
    by_size: dict[int, dict[str, str]] = {}
    for r in digests.where("NOT whole").collect():
        by_size.setdefault(r.lines, {})[r.digest] = r.license
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = []
    for size, notices in sorted(by_size.items()):
        pairs = F.create_map(*(F.lit(x) for pair in sorted(notices.items()) for x in pair))
        told = F.filter(_groups(F.col("text"), size), lambda x: F.lower(x).rlike("licen[sc]e"))
        # The lambda is called at once, with the map of this turn.
        named.append(F.transform(told, lambda x: F.try_element_at(pairs, F.sha2(canonical(x), 256))))  # noqa: B023
    named = F.concat(*named)
    return (
        read.withColumns(
            {
                "canonical_sha256": F.sha2(canonical(F.col("text")), 256),
                "notice_ids": F.array_join(F.sort_array(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ","),
            }
        )
        .join(texts, "canonical_sha256", "left")
        .select("doc_id", "canonical_sha256", "license_id", "notice_ids")
    )
