"""Rule bitmask ledger: every rule once, its outcome as a bit, its measurement kept.

``ledger`` evaluates all rules in one pass over the texts and stores a bit for each
failed rule next to the measurements. A policy is a named bit mask; ``decide``
applies it with one bitwise AND, and ``ablation`` counts for each rule what it alone
rejects, from counts by bit pattern (at most ``2 ** len(RULES)`` rows). So a policy
can be changed, compared or taken back without reading a text again.

Everything is a built-in function; a document is judged on its own row, and nothing
is shuffled before the ablation.

Defined results: a NULL or empty text has no words (all measurements 0) and fails
``few_words``; a NULL doc_id is kept as NULL; repeated rows are judged one by one;
an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import SPACE, SPACES, words_of

WINDOW = 5
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of these rules."""

    version: str
    rules: tuple[str, ...]


def _rules() -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_words", c("n_repeat_words") * 100 > c("n_words") * 20),
        Rule("many_symbols", c("n_symbols") * 100 > c("n_words") * 10),
        Rule("repeated_lines", c("n_dup_lines") * 100 > c("n_lines") * 50),
        Rule("long_words", c("word_chars") > c("n_words") * 15),
        Rule("short_words", c("word_chars") < c("n_words") * 2),
        Rule("upper_case", c("n_upper") * 100 > c("word_chars") * 60),
    ]


RULES = ("few_words", "repeated_words", "many_symbols", "repeated_lines", "long_words", "short_words", "upper_case")
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", ("few_words", "repeated_words", "many_symbols", "repeated_lines")),
        Policy("v2", RULES),
    )
}
CURRENT = "v2"


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more: sort, keep equal neighbours, add up."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of(entries: Column) -> Column:
        same = F.filter(
            entries,
            lambda x, k: F.coalesce(x["h"] == F.get(entries, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(entries, k + 1)["h"], F.lit(False)),
        )
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"].cast("long"),
        )

    # A one-element array binds the sorted entries once for all uses in the lambda.
    return F.transform(F.array(ordered), of)[0]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every rule to the rows of ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.withColumns({"__t": whole, "__w": words_of(F.col(text))})
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.trim(F.translate(x, SPACES, "      ")) != "")
    counted = read.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": (F.length("__t") - F.regexp_count("__t", F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count("__t", F.lit(SYMBOL)).cast("long"),
            "n_upper": F.regexp_count("__t", F.lit("[A-Z]")).cast("long"),
            "__l": lines,
            "__h": F.when(
                F.size("__w") >= WINDOW,
                F.transform(
                    F.slice("__w", 1, F.greatest(F.size("__w") - (WINDOW - 1), F.lit(0))),
                    lambda w, i: F.xxhash64(w, *(F.get("__w", i + k) for k in range(1, WINDOW))),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    return counted.withColumns(
        {
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.when(
                F.size(F.array_distinct("__h")) < F.size("__h"), _covered(F.col("__h"))
            ).otherwise(F.lit(0).cast("long")),
        }
    ).drop("__t", "__w", "__l", "__h")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, the measurements, and ``failed_bits`` (bit k: rule k of RULES)."""
    # The generator keeps a later filter on a rule from repeating the measurements below it.
    measured = measure(docs.select(*dict.fromkeys([*keep, text])), text).select(
        *keep, F.inline(F.array(F.struct(*MEASURES)))
    )
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.select(*keep, *MEASURES, bits.alias("failed_bits"))


def mask_of(policy: Policy) -> int:
    return sum(1 << RULES.index(name) for name in policy.rules)


def rejected(policy: Policy, bits: Column | None = None) -> Column:
    bits = F.col("failed_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def decide(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Apply a policy to a stored ledger: adds ``base_failed`` and ``kept``."""
    base = rejected(BASE)
    return entries.withColumns({"base_failed": base, "kept": ~(base | rejected(POLICIES[version]))})


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects."""
    policy = POLICIES[version]
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    sums = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(held.bitwiseAND(F.lit(1 << RULES.index(name)).cast("long")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(held == (1 << RULES.index(name)), F.col("n"))), F.lit(0)).alias("rejected_alone"),
        )
        for name in policy.rules
    ]
    return patterns.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("x")).select("x.*")
