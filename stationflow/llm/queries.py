"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import (
    collocations,
    decontamination,
    legacy_archive,
    license_digest,
    license_texts,
    mixing,
    packing,
    pii,
    prefix_forest,
    prefix_join,
    prefix_trie,
    quality_ledger,
    sql,
    suffix_dedup,
    token_spans,
)
from stationflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_ledger.decide(quality_ledger.ledger(table(spark, folder, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_bits",
    )


_OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+4]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 20)::BIGINT
    + 4 * (n_symbols * 100 > n_words * 10)::BIGINT + 8 * (n_dup_lines * 100 > n_lines * 50)::BIGINT
    + 16 * (word_chars > n_words * 15)::BIGINT + 32 * (word_chars < n_words * 2)::BIGINT
    + 64 * (n_upper * 100 > word_chars * 60)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""


def op1_legacy_archive(spark: SparkSession, folder: str) -> DataFrame:
    return legacy_archive.archived_pages(table(spark, folder, "pages"))


def op2_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    return token_spans.tokens_by_line(table(spark, folder, "documents"))


def op4_license_digest(spark: SparkSession, folder: str) -> DataFrame:
    return license_digest.scan(table(spark, folder, "documents"))


def op8_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_join.linked_components(table(spark, folder, "documents"))


def op5_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), most_kept=1_000_000)


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op10_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    form = f"lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g'))"
    for pattern in (
        r"(?m)^[ \t>*#/-]*(copyright|\(c\)|©)[^\n]*$",
        r"(?m)^[ \t>*#/-]*all rights reserved\.?[ \t]*$",
    ):
        form = f"regexp_replace({form}, {_quoted(pattern)}, '', 'g')"
    form = f"(' ' || regexp_replace({form}, '[^a-z0-9]+', ' ', 'g') || ' ')"
    for other, usual in license_digest.SPELLINGS:
        form = f"replace({form}, ' {other} ', ' {usual} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


def _op4_sql() -> str:
    texts = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in license_texts.TEXTS.items())
    notices = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, all_of in license_texts.NOTICES.items() for t in all_of)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
known_text AS (SELECT DISTINCT license, sha256({_canonical_sql("t")}) AS digest FROM (VALUES {texts}) k(license, t)),
known_notice AS (SELECT DISTINCT license, sha256({_canonical_sql("t")}) AS digest FROM (VALUES {notices}) k(license, t)),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS t FROM d),
named AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notice_ids
  FROM line JOIN known_notice ON sha256({_canonical_sql("line.t")}) = digest
  WHERE regexp_matches(lower(line.t), 'licen[sc]e') GROUP BY r
)
SELECT doc_id, sha256({_canonical_sql("d.t")}) AS canonical_sha256, license AS license_id,
  coalesce(notice_ids, '') AS notice_ids
FROM d LEFT JOIN known_text ON sha256({_canonical_sql("d.t")}) = digest LEFT JOIN named USING (r)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_legacy_archive": op1_legacy_archive,
        "op2_token_spans": op2_token_spans,
        "op3_prefix_join": op3_prefix_join,
        "op4_license_digest": op4_license_digest,
        "op5_weak_supervision_pii": op5_weak_supervision_pii,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_prefix_forest": op8_prefix_forest,
        "op9_quality_ledger": op9_quality_ledger,
        "op10_soft_mixing": op10_soft_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_collocations": op12_collocations,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_digest": _op4_sql(),
        "op9_quality_ledger": _OP9_SQL,
        "op11_prefix_trie": sql.OP11,
        "op12_collocations": sql.OP12,
        "op13_decontamination": sql.OP13,
    }
