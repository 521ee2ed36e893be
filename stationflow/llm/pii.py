"""Personal data by weak supervision, with built-in functions only.

Base spans come from four fixed patterns and their checks. Wider patterns add
candidates: spelled-out addresses, phones without a country code, grouped card
numbers, long internet addresses. Every candidate, base or not, gets the votes of
four labelers (strict pattern, gazetteer, context words, free-standing position; each
for, against or silent). Per kind, expectation-maximisation over the counts of vote
patterns (at most 3 ** 4 per kind) estimates how far each labeler can be trusted and
how likely each pattern is to be personal data. These soft labels train the span
classifier, a naive Bayes model over the span's shape, its neighbours and its digits
(each hashed to ``BUCKETS`` values, so its table is bounded). Candidates of the wider
patterns that it accepts become added spans; base spans always stay.

A text is searched on its own row. Only candidates are shuffled, and of the documents
only a row number and the spans.

Places count code points, the end is exclusive. Possessive forms and look-behinds
below change no match; they keep the search linear on long runs.

Defined results: a NULL or empty text has no spans; repeated rows are searched one by
one; a NULL doc_id is kept; an empty table gives no rows; other columns are kept only
by ``find_spans(keep=...)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Fixed values, see the docstring for their form.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns, by kind.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# What a text must hold for a pattern of the kind to match at all.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_NEEDS_WIDE = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[ -][0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
# Gazetteers: endings of mail hosts, first digits of card issuers, country codes.
TLDS = "com org net edu gov io de fr es uk info eu ch at it nl"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Context words before a span, for and against it.
FOR = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|login",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono",
}
AGAINST = r"version|release|isbn|order|invoice|serial|part no|model|doi|build"
LABELERS = 4
ROUNDS = 25
BUCKETS = 256
SLOTS = 4
ACCEPT = 0.9
SIDE = 40


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Every second digit from the right counts double, less nine beyond nine; the sum ends in zero."""
    flipped = F.reverse(number)
    places = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.substring(flipped, i, F.lit(1)).cast("int")).otherwise(
            F.substring(flipped, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(flipped, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(s))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


_SPAN = "array<struct<kind:int,start:bigint,stop:bigint,said:string,base:boolean>>"


def _located(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """All matches with their places: what lies between them gives the offsets."""
    gaps = F.split(text, pattern, -1)
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + F.length(F.get(gaps, a["k"]))
        stop = start + F.length(m)
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), m.alias("said"), F.lit(base).alias("base")
        )
        return F.struct(stop.alias("at"), (a["k"] + 1).alias("k"), F.array_append(a["spans"], span).alias("spans"))

    empty = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("k"), F.array().cast(_SPAN).alias("spans")
    )
    return F.aggregate(said, empty, step, lambda a: a["spans"])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["said"]))


def _base_spans(text: Column) -> Column:
    found = []
    for k, kind in enumerate(KINDS):
        spans = _checked(_located(text, BASE[kind], k, True), kind)
        found.append(F.when(text.rlike(_NEEDS[kind]), spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*found)


def _wide_spans(text: Column, base: Column) -> Column:
    found = []
    for k, kind in enumerate(KINDS):
        spans = _located(text, WIDE[kind], k, False)
        found.append(F.when(text.rlike(_NEEDS_WIDE[kind]), spans).otherwise(F.array().cast(_SPAN)))
    return F.filter(
        F.concat(*found),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )


def _by_kind(kind: Column, of: Callable[[str], Column]) -> Column:
    out = F.when(kind == 0, of(KINDS[0]))
    for k in range(1, len(KINDS)):
        out = out.when(kind == k, of(KINDS[k]))
    return out


def _gazetteer(kind: str, said: Column) -> Column:
    digits = _digits(said)
    if kind == "email":
        known = F.lower(said).rlike(rf"[. ](?:{TLDS.replace(' ', '|')})$")
    elif kind == "ip":
        known = ~said.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\.")
    elif kind == "card":
        known = digits.rlike(ISSUERS)
    else:
        known = digits.rlike(COUNTRIES) & (F.length(digits) >= 10)
    return F.when(known, 1).otherwise(-1)


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, a row number ``rid`` and ``spans``: every candidate with its votes and features."""
    none = F.array().cast(_SPAN)
    found = (
        docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
        .withColumn("__any", F.col("__t").rlike(r"[0-9@]|[\[(]at[\])]|[A-Fa-f]:[A-Fa-f]"))
        .withColumn("__b", F.when(F.col("__any"), _base_spans(F.col("__t"))).otherwise(none))
        .withColumn("__c", F.when(F.col("__any"), F.concat("__b", _wide_spans(F.col("__t"), F.col("__b")))).otherwise(none))
    )

    def judged(s: Column) -> Column:
        begin = F.greatest(s["start"] - SIDE, F.lit(0))
        before = F.lower(F.substring(F.col("__t"), (begin + 1).cast("int"), (s["start"] - begin).cast("int")))
        left = F.substring(F.col("__t"), s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0))
        right = F.substring(F.col("__t"), (s["stop"] + 1).cast("int"), F.lit(1))
        context = (
            F.when(before.rlike(AGAINST), -1)
            .when(_by_kind(s["kind"], lambda k: before.rlike(FOR[k])), 1)
            .otherwise(0)
        )
        free = F.when(left.rlike(r"[\p{L}\p{N}]") | right.rlike(r"[\p{L}\p{N}]"), -1).otherwise(1)
        votes = F.array(
            F.when(s["base"], 1).otherwise(0),
            _by_kind(s["kind"], lambda k: _gazetteer(k, s["said"])),
            context,
            free,
        )
        shape = F.regexp_replace(F.regexp_replace(s["said"], "[0-9]+", "9"), r"\p{L}+", "a")
        word = F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1)
        bucket = lambda v: F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int")
        features = F.array(bucket(shape), bucket(word), bucket(F.concat_ws("|", left, right)), bucket(F.length(_digits(s["said"]))))
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"),
            votes.alias("votes"), features.alias("features"),
        )

    return found.select(
        *keep, F.monotonically_increasing_id().alias("rid"), F.transform("__c", judged).alias("spans")
    )


def vote_model(found: DataFrame) -> DataFrame:
    """EM over vote patterns: (kind, votes, n, q), q the chance that the pattern is personal data."""
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes")
    patterns = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    p = F.col("p")
    start = F.transform(
        p, lambda x: 1 / (1 + F.exp(-F.aggregate(x["votes"], F.lit(0.0), lambda a, v: a + v.cast("double"))))
    )
    every = F.sequence(F.lit(0), F.size(p) - 1)

    def total(q: Column, of: Callable[[Column], Column], true: bool) -> Column:
        def add(a: Column, j: Column) -> Column:
            share = F.get(q, j) if true else 1 - F.get(q, j)
            return a + F.when(of(F.get(p, j)["votes"]), F.get(p, j)["n"] * share).otherwise(0.0)

        return F.aggregate(every, F.lit(0.0), add)

    def same_vote(x: Column, k: int) -> Callable[[Column], Column]:
        return lambda v: F.get(v, F.lit(k)) == F.get(x["votes"], F.lit(k))

    def step(q: Column, _: Column) -> Column:
        yes, no = total(q, lambda v: F.lit(True), True), total(q, lambda v: F.lit(True), False)

        def posterior(x: Column) -> Column:
            odds = F.log((yes + 1) / (no + 1))
            for k in range(LABELERS):
                same = same_vote(x, k)
                odds = odds + F.log((total(q, same, True) + 1) / (yes + 3)) - F.log((total(q, same, False) + 1) / (no + 3))
            return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))

        return F.transform(p, posterior)

    learned = by_kind.withColumn("q", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    return learned.select("kind", F.explode(F.arrays_zip("p", "q")).alias("z")).select(
        "kind", F.col("z.p.votes").alias("votes"), F.col("z.p.n").alias("n"), F.col("z.q").alias("q")
    )


def span_weights(found: DataFrame, model: DataFrame) -> DataFrame:
    """Naive Bayes weights from soft labels: (kind, slot, bucket, weight), slot -1 holds the prior.

    At most len(KINDS) * (SLOTS * BUCKETS + 1) rows.
    """
    each = found.select(F.explode("spans").alias("s")).select("s.*")
    counted = each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("m"))
    soft = counted.join(F.broadcast(model.select("kind", "votes", "q")), ["kind", "votes"])
    slots = F.posexplode(F.concat(F.array(F.lit(0)), "features")).alias("slot", "bucket")
    sums = soft.select("kind", "q", "m", slots).groupBy("kind", "slot", "bucket").agg(
        F.sum(F.col("m") * F.col("q")).alias("yes"), F.sum(F.col("m") * (1 - F.col("q"))).alias("no")
    )
    totals = sums.where("slot = 0").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    prior = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    given = F.log((F.col("yes") + 1) / (F.col("all_yes") + BUCKETS)) - F.log((F.col("no") + 1) / (F.col("all_no") + BUCKETS))
    return sums.join(F.broadcast(totals), "kind").select(
        "kind", (F.col("slot") - 1).alias("slot"), "bucket", F.when(F.col("slot") == 0, prior).otherwise(given).alias("weight")
    )


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` and ``spans``: arrays of (kind, start, stop), ordered; spans hold base and added ones."""
    found = cut(candidates(docs, text, keep))
    weights = span_weights(found, vote_model(found))
    wide = found.select("rid", F.explode(F.filter("spans", lambda s: ~s["base"])).alias("s"))
    slots = F.posexplode(F.concat(F.array(F.lit(0)), "s.features")).alias("slot", "bucket")
    scored = (
        wide.select("rid", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), slots)
        .withColumn("slot", F.col("slot") - 1)
        .join(F.broadcast(weights), ["kind", "slot", "bucket"], "left")
        .groupBy("rid", "kind", "start", "stop")
        .agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("odds"))
        .where(1 / (1 + F.exp(-F.col("odds"))) >= ACCEPT)
    )
    added = scored.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))
    plain = F.transform(
        F.filter("spans", lambda s: s["base"]),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    return (
        found.join(added, "rid", "left")
        .withColumn("base", F.sort_array(plain))
        .withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))))
        .select(*keep, "base", "spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first in place wins."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["parts"].alias("parts"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(a["parts"], F.array(gap, F.get(names, s["kind"]))).alias("parts"))
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    built = F.aggregate(
        ordered,
        start,
        step,
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, built).otherwise(text)
