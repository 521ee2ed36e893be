"""Phrase collocations by Misra-Gries summaries per hash partition and an exact second pass.

1. First pass: every task turns its texts into hashes of all phrases of 1 to ``LONGEST``
   words and summarises them per hash partition. A partition merges the summaries it gets.
   Its capacity is ``ROOM`` times its mass (phrase occurrences) over the threshold, so
   what it takes off any counter is below the threshold and every phrase that occurs
   ``least`` times survives; counters that cannot have reached it are let go.
2. The survivors' hashes become a Bloom filter of at most ``2 ** FILTER_BITS`` bits,
   the only thing that reaches the driver and the tasks. Beyond that size the filter
   lets more phrases through, which costs shuffle and changes no result.
3. Second pass: phrases that pass the filter are counted exactly, by their text, and
   those below the threshold dropped. The parts of a frequent phrase are as frequent,
   so all counts that scores need are among them.
4. Scores are exact decimal arithmetic over joins of phrases with their parts; the first
   ``TOP`` phrases of a language come from first phrases of salted parts of it.

Hashes choose what is counted and never what a count is: within a task, occurrences
are grouped by two independent 64-bit hashes, beyond it by their text.

Defined results: NULL and empty texts have no words; a NULL lang is ``und``; a text of any
length is read whole; repeated rows count as often as they stand; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.common import batches_of, cut, shuffle_partitions

LEAST = 10
LONGEST = 3
TOP = 2000
ROOM = 4
# Hash partitions for each shuffle partition, so that tasks get about as many each.
SPREAD = 4
# Text held at once by a task, and the part of it hashed at once.
BUFFER_BYTES = 12 << 20
STEP_BYTES = 1 << 20
FILTER_BITS = 29
BITS_EACH = 16
PROBES = 3
# Kinds of bytes: part of a word, between words, between pieces. Fixed values.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
# Odd multipliers of the hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACES = np.array([0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)

FIRST_SCHEMA = "p int, kind int, mass long, ones binary, keys binary, counts binary"
SECOND_SCHEMA = "lang string, words int, phrase string, f long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Words:
    """The words of a buffer of whole texts, each text ended by a line feed."""

    def __init__(self, raw: bytes, hashes: int):
        self.raw = raw.lower()  # of bytes: A-Z only
        data = np.frombuffer(self.raw, np.uint8)
        kind = _KIND[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind == 0
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start]
        self.hashes = [self._hashed(data, base) for base in _BASES[:hashes]]

    def _hashed(self, data: np.ndarray, base: int) -> np.ndarray:
        """Polynomial hashes of all words, from running sums over parts that end between words."""
        out = np.empty(len(self.start), np.uint64)
        powers = back = np.empty(0, np.uint64)
        first = 0
        while first < len(out):
            begin = self.start[first]
            last = max(int(np.searchsorted(self.end, begin + STEP_BYTES, "right")), first + 1)
            stop = self.end[last - 1]
            if len(powers) < stop - begin:
                powers = _powers(base, max(int(stop - begin), STEP_BYTES))
                back = _powers(pow(base, -1, 1 << 64), len(powers))
            sums = np.zeros(stop - begin + 1, np.uint64)
            np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * powers[: stop - begin], out=sums[1:])
            at, end = self.start[first:last] - begin, self.end[first:last] - begin
            out[first:last] = (sums[end] - sums[at]) * back[at] + (end - at).astype(np.uint64)
            first = last
        return _mixed(out)

    def phrases(self, n: int, seed: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of n words, and the words they start with."""
        h = self.hashes[which]
        if len(h) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.piece[: len(h) - n + 1] == self.piece[n - 1 :])
        g = np.full(len(at), (seed * 8 + n) & (2**64 - 1), np.uint64)
        for k in range(n):
            g += h[at + k] * _PLACES[k]
        return _mixed(g), at

    def text(self, first: int, n: int) -> bytes:
        found = self.raw[self.start[first] : self.end[first + n - 1]]
        return found if n == 1 else b" ".join(found.split())


def _seed(lang: str) -> int:
    h = 1469598103934665603
    for b in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) of bounded size; a text is never cut."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts, strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
                if size >= BUFFER_BYTES:
                    for k, parts in held.items():
                        yield k, b"\n".join(parts) + b"\n"
                    held, size = {}, 0
    for k, parts in held.items():
        yield k, b"\n".join(parts) + b"\n"


def _partition(g: np.ndarray, parts: int) -> np.ndarray:
    """Hash partitions are ranges of the upper half; the lower half is the key inside one."""
    return ((g >> _HALF) * np.uint64(parts)) >> _HALF


def _summaries(parts: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in _buffers(batches):
            words, seed = _Words(raw, 1), _seed(lang)
            g = np.concatenate([words.phrases(n, seed)[0] for n in range(1, LONGEST + 1)])
            if not len(g):
                continue
            g.sort()
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            count = np.diff(np.append(first, len(g)))
            key = g[first]
            at = _partition(key, parts).astype(np.int64)
            key = (key & _LOW).astype(np.uint32)
            bounds = np.searchsorted(at, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                own = slice(bounds[p], bounds[p + 1])
                k, c = key[own], count[own]
                one = c == 1
                mass = int(c.sum())
                rows = [
                    (p, 0, mass, None, None, None),
                    (p, 1, mass, k[one].tobytes(), k[~one].tobytes(), np.minimum(c[~one], _LOW).astype(np.uint32).tobytes()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _FIRST_TYPES, strict=True)], _FIRST_NAMES
                )

    return of


_FIRST_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
_FIRST_NAMES = ["p", "kind", "mass", "ones", "keys", "counts"]


class Summary:
    """Misra-Gries counters of one hash partition; ``lost`` is the most that any counter lacks.

    ``mass`` is all that will be added, so ``lost <= mass / (capacity + 1) < least / ROOM``.
    """

    def __init__(self, mass: int, least: int):
        self.least = least
        self.capacity = ROOM * mass // least + 1
        self.lost = 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.uint64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > self.capacity:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)]).astype(np.uint64)
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)]).astype(np.uint64)
        self.waiting, self.held = [], 0
        both = (keys << _HALF) | np.minimum(counts, _LOW)
        both.sort()
        keys, counts = both >> _HALF, both & _LOW
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
        self.keys = keys[first].astype(np.uint32)
        self.counts = np.minimum(np.add.reduceat(counts, first), _LOW) if len(first) else counts
        if len(self.keys) > self.capacity:
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            stay = self.counts > off
            self.keys, self.counts = self.keys[stay], self.counts[stay] - off
            self.lost += int(off)

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        self._merge()
        return self.keys[self.counts + np.uint64(self.lost) >= np.uint64(self.least)]


def _merged(least: int):
    """Rows ordered by partition, those with the masses first."""

    def out(p: int, summary: Summary) -> pa.RecordBatch:
        kept = summary.survivors()
        return pa.RecordBatch.from_arrays(
            [pa.array([p], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([kept.tobytes()], pa.binary())], ["p", "n", "keys"]
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, kind, m, ones, keys, counts = row
                if p != now:
                    if summary is not None:
                        yield out(now, summary)
                    now, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(mass, least)
                one = np.frombuffer(ones, np.uint32)
                summary.add(one, np.ones(len(one), np.uint64))
                summary.add(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32).astype(np.uint64))
        if summary is not None:
            yield out(now, summary)

    return of


def _probes(p: np.ndarray, key: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """The bits of a key: ``PROBES`` places in the slice of its partition."""
    h = key.astype(np.uint64)
    begin = p.astype(np.uint64) * np.uint64(each)
    for _ in range(PROBES):
        h = _mixed(h + np.uint64(0x51ED2701))
        yield begin + (((h >> _HALF) * np.uint64(each)) >> _HALF)


def _slices(each: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.zeros(each, np.uint8)
                for at in _probes(np.zeros(1, np.uint64), np.frombuffer(raw, np.uint32), each):
                    bits[at.astype(np.int64)] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["p", "bits"]
                )

    return of


def _exact(filter_of, parts: int, each: int):
    """Counts, per buffer, of the phrases that pass the filter; the words of a language as n = 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(filter_of.value, np.uint8)
        for lang, raw in _buffers(batches):
            words, seed = _Words(raw, 2), _seed(lang)
            if not len(words.start):
                continue
            sizes, texts, counts = [0], [""], [len(words.start)]
            for n in range(1, LONGEST + 1):
                g, at = words.phrases(n, seed)
                p, key = _partition(g, parts), g & _LOW
                passed = np.arange(len(g))
                for bit in _probes(p, key, each):
                    # Each probe looks only at what has passed so far.
                    bit = bit[passed].astype(np.int64)
                    passed = passed[(held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if not len(passed):
                    continue
                g, at = g[passed], at[passed]
                g2 = words.phrases(n, seed, 1)[0][passed]
                order = np.argsort(g)
                if not np.array_equal(np.flatnonzero(np.diff(g[order])), np.flatnonzero(np.diff(g[order]) | np.diff(g2[order]))):
                    order = np.lexsort((g2, g))  # two phrases share the first hash
                g, g2, at = g[order], g2[order], at[order]
                first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])))
                sizes += [n] * len(first)
                texts += [words.text(i, n).decode("utf-8", "surrogatepass") for i in at[first].tolist()]
                counts += np.diff(np.append(first, len(g))).tolist()
            for k in range(0, len(sizes), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(sizes[part]), pa.string()), pa.array(sizes[part], pa.int32()),
                        pa.array(texts[part], pa.string()), pa.array(counts[part], pa.int64()),
                    ],
                    ["lang", "words", "phrase", "f"],
                )

    return of


def survivors(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """Hash partitions with the keys of all phrases that may occur ``least`` times, and their number."""
    spark = docs.sparkSession
    parts = SPREAD * shuffle_partitions(spark)
    summed = (
        docs.mapInArrow(_summaries(parts), FIRST_SCHEMA)
        .repartition(shuffle_partitions(spark), "p")
        .sortWithinPartitions("p", "kind")
        .mapInArrow(_merged(least), "p int, n long, keys binary")
    )
    with batches_of(spark, 64):
        return cut(summed), parts


def _filter(spark: SparkSession, found: DataFrame, parts: int) -> tuple[bytes, int]:
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A slice of each partition, a whole number of bytes.
    each = max(min(BITS_EACH * n // parts, (1 << FILTER_BITS) // parts) // 8 * 8, 64)
    bits = bytearray(parts * each // 8)
    with batches_of(spark, 16):
        for row in found.mapInArrow(_slices(each), "p int, bits binary").toLocalIterator():
            bits[row.p * each // 8 : (row.p + 1) * each // 8] = row.bits
    return bytes(bits), each


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact counts ``(lang, words, phrase, f)`` of all phrases with f >= least, and ``(lang, n)``."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    found, parts = survivors(read, least)
    bits, each = _filter(spark, found, parts)
    held = spark.sparkContext.broadcast(bits)
    counted = read.mapInArrow(_exact(held, parts, each), SECOND_SCHEMA)
    totals = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    with batches_of(spark, 256):
        kept = cut(totals)
    return kept.where("words > 0"), kept.where("words = 0").select("lang", F.col("f").alias("n"))


def _scored(phrases: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its lowest-scoring cut."""
    longer = phrases.where("words > 1").withColumn("w", F.split("phrase", " ", -1))
    cuts = longer.select(
        "lang", "words", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "words", "phrase", "a", "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right"),
    )
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # Decimals of 38 digits hold a * a * 10 ** 6 up to counts of 10 ** 16.
    a, l, r = (f"cast({x} AS decimal(19,0))" for x in "alr")
    score = F.expr(f"(cast({a} * {a} AS decimal(31,0)) * 1000000) div ({l} * {r})")
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    best = joined.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "words", "phrase", "a", "m.l", "m.r", "m.score")


def _uncovered(phrases: DataFrame, scored: DataFrame) -> DataFrame:
    """Without phrases that mostly stand inside one longer phrase."""
    inner = [
        F.struct(F.expr(f"slice(w, {i}, {n})").alias("w"))
        for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)
    ]
    longer = phrases.where("words > 2").withColumn("w", F.split("phrase", " ", -1))
    within = (
        longer.select("lang", "words", "f", F.explode(F.array(*inner)).alias("x"))
        .where("size(x.w) < words")
        .groupBy("lang", F.array_join("x.w", " ").alias("phrase")).agg(F.max("f").alias("most"))
    )
    return scored.join(within, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 50 * a").drop("most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least, text, lang)
    scored = cut(_uncovered(phrases, _scored(phrases)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    some = (
        scored.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
        .where(F.col("rank") <= top)
    )
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
