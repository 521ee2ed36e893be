"""Removal of repeated substrings by sparse suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

Each window of ``LENGTH`` bytes has an anchor: the smallest hash among its runs of
``GRAM`` bytes, the leftmost if equal. Equal windows have equal anchors at equal
places, and neighbouring windows mostly share one, so about one position in 85 is an
anchor and owns a stretch of windows. Anchors, not suffixes of all positions, are
shuffled:

1. Anchors meet by the hash of their run. Where the whole stretch (all bytes of its
   windows) stands twice, all its windows repeat. An anchor alone drops out.
2. What is left are the edges of repeated passages. Only for these, the bytes around
   the anchor are fetched and meet by anchor. The suffixes from the anchor on, and the
   reversed prefixes before it, are put in order by deep-shallow sorting; the common
   prefixes of neighbours say which windows of which anchors are equal.
3. An anchor with more than ``LARGE`` different surroundings is not gathered in one
   task: its windows are counted one by one by a 128-bit hash instead.

Texts are known by their MD5. Equal texts of ``LENGTH`` bytes or more repeat as a
whole. Ranges to remove meet their text once at the end.

Defined results: NULL and empty texts, and texts shorter than ``LENGTH``, lose
nothing; repeated rows are equal texts; a NULL doc_id is kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches, cut
from stationflow.llm.suffix_sort import deep_shallow

LENGTH = 200
GRAM = 32
LARGE = 65_536
SLICE = 16
SEGMENT = 1 << 23
_PLACE_BITS = 24
_STEPS = ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0x85EBCA77C2B2AE63), (16, 0x27D4EB2F165667C5))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each anchor and the starts of the windows it owns, in order."""
    places, firsts, lasts = [], [], []
    width = LENGTH - GRAM + 1
    for begin in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = np.frombuffer(data, np.uint8, min(SEGMENT + LENGTH - 1, len(data) - begin), begin)
        h = part.astype(np.uint64) + np.uint64(1)
        for step, factor in _STEPS:
            h = h[:-step] * np.uint64(factor) + h[step:]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        keyed = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        own = (_window_min(keyed, width) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(own)) + 1
        first = np.concatenate(([0], edge))
        last = np.concatenate((edge - 1, [len(own) - 1]))
        places.append(own[first] + begin)
        firsts.append(first + begin)
        lasts.append(last + begin)
    if not places:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # equal texts of a task give their anchors once; they repeat as a whole
    for batch in batches:
        keys, grams, stretches, place, first, last = [], [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key in seen:
                continue
            seen.add(key)
            data = text.encode("utf-8", "surrogatepass")
            p, a, b = anchors(data)
            keys.extend([key] * len(p))
            grams.extend(xxhash.xxh3_64_intdigest(data[x : x + GRAM]) for x in p.tolist())
            stretches.extend(
                xxhash.xxh3_64_intdigest(data[x : y + LENGTH], z - x)
                for x, y, z in zip(a.tolist(), b.tolist(), p.tolist(), strict=True)
            )
            place.append(p)
            first.append(a)
            last.append(b)
        if keys:
            yield pa.record_batch(
                {
                    "gram": pa.array(_signed(grams)),
                    "stretch": pa.array(_signed(stretches)),
                    "key": pa.array(keys, pa.binary()),
                    "place": pa.array(np.concatenate(place)),
                    "first": pa.array(np.concatenate(first)),
                    "last": pa.array(np.concatenate(last)),
                }
            )


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, text, edges -> per edge anchor the bytes before and after it, once per text."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for _, key, text, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key in seen:
                continue
            seen.add(key)
            data = text.encode("utf-8", "surrogatepass")
            for e in edges:
                p, a, b = e["place"], e["begin"], e["stop"]
                rows.append((e["gram"], e["large"], key, p, p - b + LENGTH, data[a:p], data[p:b]))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["gram", "large", "key", "place", "low", "before", "after"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def equal_windows(low: list[int], before: list[bytes], after: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each anchor, the ranges (both ends included) of distances from window start to
    anchor at which its window equals that of another one."""
    d = len(low)
    order_after, shared_after = deep_shallow(after)
    order_before, shared_before = deep_shallow([s[::-1] for s in before])
    if d <= 6:
        out: list[list[tuple[int, int]]] = [[] for _ in range(d)]
        rank = {k: r for r, k in enumerate(order_before)}
        for x in range(d):
            reach = LENGTH
            for y in range(x + 1, d):
                reach = min(reach, shared_after[y])
                j, k = order_after[x], order_after[y]
                r = sorted((rank[j], rank[k]))
                left = min(shared_before[r[0] + 1 : r[1] + 1])
                i, top = max(low[j], low[k], LENGTH - reach), left
                if i <= top:
                    out[j].append((i, top))
                    out[k].append((i, top))
        return out
    high = np.array([len(s) for s in before])
    lows = np.array(low)
    base, top = int(lows.min()), int(high.max())
    equal = np.zeros((top + 1 - base, d), bool)
    after_steps, before_steps = np.array(shared_after), np.array(shared_before)
    for begin in range(base, top + 1, SLICE):  # a bounded part of distances by anchors at once
        distance = np.arange(begin, min(begin + SLICE, top + 1))[:, None]
        right, left = np.empty((len(distance), d), np.int64), np.empty((len(distance), d), np.int64)
        right[:, order_after] = (after_steps[None, :] < LENGTH - distance).cumsum(axis=1)
        left[:, order_before] = (before_steps[None, :] < distance).cumsum(axis=1)
        kind = right * (d + 1) + left
        own = (distance >= lows) & (distance <= high)
        kind[~own] = -1 - np.broadcast_to(np.arange(d), kind.shape)[~own]
        order = np.argsort(kind, axis=1, kind="stable")
        sorted_kind = np.take_along_axis(kind, order, axis=1)
        same = sorted_kind[:, 1:] == sorted_kind[:, :-1]
        twice = np.zeros(kind.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        np.put_along_axis(equal[begin - base : begin - base + len(distance)], order, twice, axis=1)
    out = []
    for x in range(d):
        hits = np.flatnonzero(equal[:, x])
        if len(hits) == 0:
            out.append([])
            continue
        cuts = np.flatnonzero(np.diff(hits) > 1)
        begins, ends = hits[np.concatenate(([0], cuts + 1))], hits[np.concatenate((cuts, [len(hits) - 1]))]
        out.append([(base + int(i), base + int(j)) for i, j in zip(begins, ends, strict=True)])
    return out


def _sorted_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by gram; each gram's rows are held together, at most LARGE of them."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        found = equal_windows([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows])
        return [
            (r[1], r[2] - top, r[2] - i + LENGTH) for r, ranges in zip(rows, found, strict=True) for i, top in ranges
        ]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.record_batch(
            {
                "key": pa.array(columns[0], pa.binary()),
                "begin": pa.array(columns[1], pa.int64()),
                "stop": pa.array(columns[2], pa.int64()),
            }
        )

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                out.extend(solve(held))
                held = []
            held.append(row)
        yield batch_of(out)
    yield batch_of(solve(held))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, keys, begins = [], [], []
        for key, place, low, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, high = before + after, len(before)
            for i in range(low, high + 1):
                hashes.append(xxhash.xxh3_128_digest(data[high - i : high - i + LENGTH]))
                keys.append(key)
                begins.append(place - i)
        yield pa.record_batch(
            {"window": pa.array(hashes, pa.binary()), "key": pa.array(keys, pa.binary()), "begin": pa.array(begins, pa.int64())}
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, removed, spans, at, open_at = hashlib.sha256(), 0, 0, 0, None
            for r in sorted((r["begin"], r["stop"]) for r in ranges or ()):
                begin, stop = r[0], min(r[1], len(data))
                if open_at is None or begin > at:
                    kept.update(data[at:begin])
                    spans += 1
                    open_at = at = begin
                if stop > at:
                    removed += stop - at
                    at = stop
            kept.update(data[at:])
            rows.append((doc_id, len(data), removed, spans, kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _runs(ranges: Column) -> Column:
    """Join ordered ranges that touch; both their ends rise, as those of anchors do."""
    firsts = F.filter(ranges, lambda r, k: (k == 0) | (r["begin"] > F.get(ranges, k - 1)["stop"]))
    lasts = F.filter(ranges, lambda r, k: (k == F.size(ranges) - 1) | (F.get(ranges, k + 1)["begin"] > r["stop"]))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["begin"].alias("begin"), b["stop"].alias("stop")))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text, key; key the MD5 of the text) to ranges (key, begin, stop) of bytes that go."""
    whole = (
        texts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("stop"))
        .where(f"n > 1 AND stop >= {LENGTH}")
        .select("key", F.lit(0).cast("long").alias("begin"), "stop")
    )
    found = texts.select("key", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(
        _anchor_rows, "gram long, stretch long, key binary, place long, first long, last long"
    ).repartition("gram")  # one exchange serves the windows over (gram, stretch) and over gram
    of_gram, of_stretch = Window.partitionBy("gram"), Window.partitionBy("gram", "stretch")
    met = (
        found.withColumns(
            {
                "twins": F.count(F.lit(1)).over(of_stretch),
                "nth": F.row_number().over(of_stretch.orderBy("key", "place")),
            }
        )
        .withColumns(
            {
                "all": F.count(F.lit(1)).over(of_gram),
                "single": F.sum((F.col("twins") == 1).cast("long")).over(of_gram),
                "fetched": F.sum((F.col("nth") == 1).cast("long")).over(of_gram),
            }
        )
        .where("all > 1")
    )
    edge = (F.col("nth") == 1) & (F.col("single") > 0)
    begin, stop = F.col("first").cast("int"), (F.col("last") + LENGTH).cast("int")
    per_text = (
        met.select(
            "key",
            F.when(F.col("twins") > 1, F.struct(begin.alias("begin"), stop.alias("stop"))).alias("known"),
            F.when(
                edge,
                F.struct(
                    "gram", (F.col("fetched") > LARGE).alias("large"), F.col("place").cast("int").alias("place"),
                    begin.alias("begin"), stop.alias("stop"),
                ),
            ).alias("edge"),
        )
        .where("known IS NOT NULL OR edge IS NOT NULL")
        .groupBy("key")
        .agg(F.collect_list("edge").alias("edges"), F.sort_array(F.collect_list("known")).alias("known"))
        .withColumn("known", _runs(F.col("known")))
    )
    per_text = cut(per_text)
    edges = (
        texts.join(per_text.where(F.size("edges") > 0).select("key", "edges"), "key")
        .select("doc_id", "key", "text", "edges")  # the columns of the last join, so that one exchange serves both
        .mapInArrow(
            _surroundings, "gram long, large boolean, key binary, place long, low long, before binary, after binary"
        )
    )
    ordered = (
        edges.where("NOT large").select("gram", "key", "place", "low", "before", "after")
        .repartition("gram").sortWithinPartitions("gram")
    )
    from_sort = ordered.mapInArrow(_sorted_edges, "key binary, begin long, stop long")
    windows = edges.where("large").select("key", "place", "low", "before", "after").mapInArrow(
        _window_hashes, "window binary, key binary, begin long"
    )
    common = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    from_hashes = windows.join(common, "window").select("key", "begin", (F.col("begin") + LENGTH).alias("stop"))
    known = per_text.select("key", F.explode("known").alias("r")).select(
        "key", F.col("r.begin").cast("long").alias("begin"), F.col("r.stop").cast("long").alias("stop")
    )
    return whole.union(known).union(from_sort).union(from_hashes)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "key", F.unhex(F.md5("text"))
    ).where("key IS NOT NULL")  # always; said here so that both joins read the same
    ranges = (
        repeated_ranges(read)
        .groupBy("key")
        .agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))
    )
    return (
        read.join(ranges, "key", "left").select("doc_id", "text", "ranges")
        .mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
