"""Benchmark decontamination: windows of test words in a broadcast hash set, texts scanned against it.

1. Every benchmark item becomes its windows of ``WINDOW`` consecutive normalised words;
   an item of fewer words is one window. Windows are kept once, with a 64-bit hash.
2. Each distinct position of a text is hashed over the window lengths that occur in
   the benchmark and looked up. Up to ``session.BROADCAST_ROWS`` windows the set is
   broadcast, hits are verified word by word and no text leaves its task. A larger
   benchmark is joined by shuffle on two independent 64-bit hashes; texts stay where they are
   then too.
3. Hits are kept per text digest, so copies of a document are counted once and no
   row needs a number. ``scan`` joins them back; ``decontaminate`` removes the spans or
   the documents.

Everything is a built-in function.

Defined results: NULL and empty texts have no words and no hits; NULL or wordless items
have no windows; items that share an id count once, a NULL id is one item written as
the empty string; repeated documents are judged one by one; an empty benchmark hits
nothing; an empty table gives no rows; other columns are not read by ``scan`` and kept
by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import cut
from stationflow.session import BROADCAST_ROWS, settle

WINDOW = 10
# A-Z are word characters before lower-casing. Fixed values.
# Separators stand one by one: the regular expression engine then looks a character up in
# one bit set, where ranges are tried one after the other.
_SEPARATORS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{_SEPARATORS}]+"
BETWEEN = f"[{_SEPARATORS}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def normal_words(text: str) -> Column:
    """Words with A-Z lower-cased and every other letter as it is."""
    whole = _whole(text)
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _digest(text: str) -> Column:
    return F.md5(_whole(text))


def benchmark_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """``(window, gram, item)``: the distinct windows of every item, named by their digest."""
    # Generators keep later filters from repeating the work below them.
    read = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.explode(F.array(normal_words(text))).alias("w"))
    last = F.size("w") - F.least(F.size("w"), F.lit(window)) + 1
    starts = read.select("item", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(1), last))).alias("i"))
    grams = starts.select("item", F.expr(f"slice(w, i, least(size(w), {window}))").alias("gram"))
    return grams.select(F.md5(F.array_join("gram", " ")).alias("window"), "gram", "item").distinct()


def _second(words: Column) -> Column:
    return F.xxhash64(F.lit("second"), words)


def occurrences(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """``(digest, at, length, window)``: where windows stand in the texts, word places from 1.

    Rows of equal texts are equal. ``windows`` must be settled (written) already.
    """
    known = windows.select("window", "gram").distinct().select(
        "window", F.size("gram").alias("length"), F.xxhash64("gram").alias("h"), _second(F.col("gram")).alias("h2"), "gram"
    )
    lengths = sorted(r.length for r in known.select("length").distinct().collect()) or [WINDOW]
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    k = len(lengths)
    words = docs.select(_digest(text).alias("digest"), F.explode(F.array(normal_words(text))).alias("w"))
    places = words.select(
        "digest", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") * k - 1))).alias("x")
    )
    at = F.col("x") + 1 if k == 1 else F.expr(f"x div {k} + 1").cast("int")
    length = F.lit(lengths[0]) if k == 1 else F.get(F.array(*map(F.lit, lengths)), F.col("x") % k)
    found = places.select("digest", "w", at.alias("at"), length.alias("n")).where("at + n - 1 <= size(w)")
    gram = F.slice("w", F.col("at"), F.col("n"))
    if small:
        hit = found.withColumn("g", F.xxhash64(gram)).join(
            F.broadcast(known.select("window", "length", "h", "gram")), (F.col("g") == F.col("h")) & (gram == F.col("gram"))
        )
    else:
        hashed = found.select("digest", "at", F.xxhash64(gram).alias("g"), _second(gram).alias("g2"))
        hit = hashed.join(known.drop("gram"), (F.col("g") == F.col("h")) & (F.col("g2") == F.col("h2")))
    return hit.select("digest", "at", "length", "window").distinct()


def _judged(docs: DataFrame, items: DataFrame, window: int, text: str, item_key: str) -> tuple[DataFrame, DataFrame]:
    windows = cut(benchmark_windows(items, window, text, item_key))
    return windows, cut(occurrences(docs, windows, text))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows, hits = _judged(docs, items, window, text, item_key)
    covered = (
        hits.select("digest", F.explode(F.expr("sequence(at, at + length - 1)")).alias("place"))
        .distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        hits.select("digest", "window").distinct().join(windows.select("window", "item"), "window")
        .groupBy("digest", "item").agg(F.lit(1).alias("one"))
        .groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    # Broadcast up to a checked size, else an exchange of its own, whose skew can be split.
    per_text = settle(covered.join(named, "digest").withColumnRenamed("digest", "d"))
    read = docs.select("doc_id", F.regexp_count(_whole(text), F.lit(WORD)).cast("long").alias("n_words"), _digest(text).alias("digest"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return read.join(per_text, F.col("digest") == F.col("d"), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _runs(hits: DataFrame) -> DataFrame:
    """Hit words per text as maximal runs (first, last)."""
    places = hits.select("digest", F.explode(F.expr("sequence(at, at + length - 1)")).alias("p")).distinct()
    group = F.col("p") - F.row_number().over(Window.partitionBy("digest").orderBy("p"))
    runs = places.select("digest", "p", group.alias("g")).groupBy("digest", "g").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    return runs.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__runs"))


def _without(text: str, runs: str) -> Column:
    """The text without its runs: from the first letter of a run to the last, separators inside included."""
    parts = F.regexp_extract_all(_whole(text), F.lit(f"{WORD}|{BETWEEN}"), F.lit(0))
    starts_with_word = F.regexp_like(_whole(text), F.lit(f"^{WORD}")).cast("int")

    def keep(_: Column, i: Column) -> Column:
        # Words and separators alternate, so the place tells the number of the last word begun.
        number = F.floor((i + 1 + starts_with_word) / 2)
        is_word = (i + starts_with_word) % 2 == 1
        return ~F.exists(
            F.col(runs), lambda r: (number >= r["first"]) & F.when(is_word, number <= r["last"]).otherwise(number < r["last"])
        )

    return F.array_join(F.filter(parts, keep), "")


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "spans", window: int = WINDOW, text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """``docs`` without its hit spans (``remove="spans"``) or without hit documents (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    _, hits = _judged(docs, items, window, text, item_key)
    marked = docs.withColumn("__digest", _digest(text))
    if remove == "documents":
        gone = hits.select(F.col("digest").alias("__digest")).distinct()
        return marked.join(gone, "__digest", "left_anti").select(*docs.columns)
    runs = _runs(hits).withColumnRenamed("digest", "__digest")
    clean = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(_without(text, "__runs"))
    return marked.join(runs, "__digest", "left").withColumn(text, clean).select(*docs.columns)
