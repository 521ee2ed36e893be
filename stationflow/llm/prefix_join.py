"""N-gram Jaccard join by grouped prefixes (documents with equal prefix and size join as one).

1. Every text becomes the set of its 5-word shingles, as 64-bit hashes.
2. A first pass counts shingles in buckets, some ``SKETCH_LOAD`` bytes of text to each and
   at most ``2 ** SKETCH_MOST`` (one byte each: the logarithm of the count). The order of
   all shingles is (bucket count, hash): rare ones first. Any order gives right results;
   this one keeps passages that many documents share out of the prefixes, as long as their
   counts stand out from those of full buckets.
3. Two sets with Jaccard similarity of ``percent`` share one of their first
   ``n - ceil(percent * n / 100) + 1`` shingles. Equal sets are one class, classes of
   equal size and prefix one group; only groups are posted under their prefix
   shingles.
4. Short posting lists give group pairs, filtered by size and by the place of the
   shared shingle, then expanded to classes and verified on the whole sets. Long
   lists (large groups of near copies) give no pairs: the groups that share them form
   a cluster. A cluster of more than one block falls into bands of sizes, of which only
   neighbours can link; the sets of two neighbours meet in blocks of bounded size. A task
   compares a block pair until its documents fall into final parts, by prefixes in the
   order of the block pair's own counts, and emits a spanning set of links.
5. Links become components (``components.py``).

Nothing is capped: list length only chooses between pairs and blocks. Only the bucket
counts and a bitmap of at most ``2 ** BITMAP_BITS`` bits of candidate ids reach the
driver; both are bounded (64 MB and 4 MB).

Defined results: NULL or empty texts have no shingles and link with nothing; a text
of 1 to 4 words is one shingle; repeated rows are kept, rows of one doc_id are one
node; a row with NULL doc_id takes no part and has a NULL component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches, cut
from stationflow.llm.components import components

SHINGLE = 5
SKETCH_BITS = 20
SKETCH_MOST = 26
SKETCH_LOAD = 400
SKETCH_PARTS = 64
SKETCH_FLUSH = 1 << 22
BITMAP_BITS = 25
SHORT_LIST = 64
GROUP_PAIRS = 8
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 2_000_000
# Odd multipliers that tell the five places of a shingle apart.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5],
    dtype=np.uint64,
)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as ordered 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        g = np.array([np.sum(h * _PLACES[:n], dtype=np.uint64) + np.uint64(n)], np.uint64)
    else:
        g = h[: n - 4] * _PLACES[0]
        for k in range(1, SHINGLE):
            g += h[k : n - 4 + k] * _PLACES[k]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def sketch_bits(n_bytes: int) -> int:
    """Bits of a bucket number for so many bytes of text."""
    return min(SKETCH_MOST, max(SKETCH_BITS, (n_bytes // SKETCH_LOAD).bit_length()))


def coded(steps: np.ndarray) -> bytes:
    """Steps between ordered numbers: a byte 255 for every 255, then what is left."""
    whole = steps // 255
    out = np.full(len(steps) + int(whole.sum()), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = steps % 255
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    """The ordered numbers of ``coded`` steps."""
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _bucket_counter(bits: int):
    """Ordered bucket numbers, repeats included, as steps: about a byte each."""
    starts = np.arange(SKETCH_PARTS + 1, dtype=np.int64) * ((1 << bits) // SKETCH_PARTS)

    def parts(kept: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(kept)).astype(np.int64)
        at = np.searchsorted(buckets, starts)
        filled = np.flatnonzero(np.diff(at))
        data = [coded(np.diff(buckets[at[p] : at[p + 1]], prepend=starts[p])) for p in filled]
        return pa.record_batch({"part": pa.array(filled, pa.int32()), "counts": pa.array(data, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for _, text in _texts(batch):
                kept.append((shingle_set(text) >> np.uint64(64 - bits)).astype(np.uint32))
                held += len(kept[-1])
                if held >= SKETCH_FLUSH:
                    yield parts(kept)
                    kept, held = [], 0
        if held:
            yield parts(kept)

    return count


def _bucket_adder(bits: int):
    """Sums as bytes: eight steps for every doubling of the count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in _texts(batch):
                if part not in sums:
                    sums[part] = np.zeros((1 << bits) // SKETCH_PARTS, np.int64)
                np.add.at(sums[part], decoded(data), 1)
        levels = [np.minimum(8 * np.log2(np.maximum(v, 1)), 255).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.record_batch({"part": pa.array(list(sums), pa.int32()), "counts": pa.array(levels, pa.binary())})

    return add


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles (once per document) fall into each bucket, as ``8 * log2`` in a byte."""
    schema = "part int, counts binary"
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = (
        docs.mapInArrow(_bucket_counter(bits), schema).repartition(SKETCH_PARTS, "part")
        .mapInArrow(_bucket_adder(bits), schema).collect()
    )
    counts = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint8)
    for row in rows:
        counts[row.part] = np.frombuffer(row.counts, np.uint8)
    return counts.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _profiler(counts, percent: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        shift = np.uint64(64 - (len(count).bit_length() - 1))
        for batch in batches:
            ids, sizes, digests, keys, prefixes = [], [], [], [], []
            for doc_id, text in _texts(batch):
                g = shingle_set(text)
                order = np.argsort(count[(g >> shift).astype(np.int64)], kind="stable")
                first = g[order[: prefix_length(len(g), percent)]]
                ids.append(doc_id)
                sizes.append(len(g))
                digests.append(xxhash.xxh3_128_digest(g.tobytes()))
                keys.append(xxhash.xxh3_64_intdigest(first.tobytes()) - (1 << 63))
                prefixes.append(first.view(np.int64))
            offsets = np.cumsum([0, *map(len, prefixes)])
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n": pa.array(sizes, pa.int32()),
                    "digest": pa.array(digests, pa.binary()),
                    "pkey": pa.array(keys, pa.int64()),
                    "prefix": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                }
            )

    return profile


def _bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes, gathered in pieces of 4 kB; at most 2 ** BITMAP_BITS bits."""
    bit = _bit(F.col("id"))
    rows = (
        ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    whole = np.zeros(((1 << BITMAP_BITS) >> 15) + 2, dtype=(np.uint8, 4096))
    for row in rows:
        whole[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return whole


def _bitmap_has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """bitmap_bucket_number counts from 1 above zero; position is what is left of 32,768."""
    bucket = np.where(bits > 0, 1 + (bits - 1) // 32768, 0)
    place = np.where(bits > 0, (bits - 1) % 32768, 0)
    return (bitmap[bucket, place // 8] >> (place % 8).astype(np.uint8)) & 1 > 0


def _set_maker(bitmap):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = _bitmap_has(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(wanted))
            made = [shingle_set(t) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, made)])
            values = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "shingles": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                }
            )

    return sets


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links among these shingle sets.

    A set outside the largest part so far is compared with all others that share a shingle
    of its prefix, in the order of the counts here; sets in the largest part need not be
    compared with each other.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    # Each set's shingles, rare ones first.
    owner = np.repeat(np.arange(m), sizes)
    ids = rank[ids]
    ids = ids[np.lexsort((ids, owner))]
    firsts = sizes - -(-percent * sizes // 100) + 1
    in_prefix = np.arange(len(ids)) - starts[owner] < firsts[owner]
    token, member = ids[in_prefix], owner[in_prefix]
    by_token = np.argsort(token, kind="stable")
    lists = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(counts)))))
    member = member[by_token]
    flag = np.zeros(len(counts), np.int64)
    part, done, links = np.arange(m), np.zeros(m, bool), []
    while True:
        largest = np.bincount(part).argmax()
        todo = np.flatnonzero(~done & (part != largest)) if done.any() else np.arange(m)
        if len(todo) == 0:
            return links
        x = todo[len(todo) // 2]
        done[x] = True
        own = ids[starts[x] : starts[x] + sizes[x]]
        near = np.zeros(m, bool)
        for t in own[: firsts[x]]:
            near[member[lists[t] : lists[t + 1]]] = True
        near &= (part != part[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        other = np.flatnonzero(near)
        if len(other) == 0:
            continue
        ends = np.cumsum(sizes[other])
        at = np.arange(ends[-1]) + np.repeat(starts[other] - (ends - sizes[other]), sizes[other])
        flag[own] = 1
        shared = np.add.reduceat(flag[ids[at]], ends - sizes[other])
        flag[own] = 0
        for y in other[100 * shared >= percent * (sizes[other] + sizes[x] - shared)]:
            if part[y] != part[x]:
                links.append((int(x), int(y)))
                part[part == part[y]] = part[x]


def _block_links(percent: int):
    def unit(key, frame):
        ids = frame["id"].to_numpy()
        found = links_within([np.asarray(s) for s in frame["shingles"]], percent)
        import pandas as pd

        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    return unit


def join_classes(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, n_shingles, class_id; links: a, b between classes)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = spark.sparkContext.broadcast(bucket_counts(read))
    schema = "doc_id long, n int, digest binary, pkey long, prefix array<long>"
    profile = cut(read.mapInArrow(_profiler(counts, percent), schema))

    some = profile.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n", "digest").agg(F.min("doc_id").alias("id"), F.min("pkey").alias("pkey"))
    grouped = classes.groupBy("n", "pkey").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("m"))
    classes, grouped = cut(classes), cut(grouped)
    member = classes.join(grouped, ["n", "pkey"]).select("id", "n", "gid", "m")

    leaders = some.select("doc_id", "n", "pkey", "prefix").join(
        grouped.select(F.col("gid").alias("doc_id"), "n", "pkey", "m"), ["doc_id", "n", "pkey"]
    ).dropDuplicates(["doc_id", "n", "pkey"])
    posts = leaders.select(F.col("doc_id").alias("gid"), "n", "m", F.posexplode("prefix").alias("pos", "token"))
    of_token = Window.partitionBy("token")
    listed = cut(
        posts.withColumns({"len": F.count(F.lit(1)).over(of_token), "first": F.min("gid").over(of_token)}).where("len > 1")
    )

    short = listed.where(F.col("len") <= SHORT_LIST)
    x, y = short.select("token", *(F.col(c).alias(f"{c}_x") for c in ("gid", "n", "m", "pos"))), short.select(
        "token", *(F.col(c).alias(f"{c}_y") for c in ("gid", "n", "m", "pos"))
    )
    most = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    pairs = cut(
        x.join(y, "token")
        .where("gid_x < gid_y")
        .where(F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
        .where(most * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
        .select("gid_x", "gid_y", "m_x", "m_y")
        .distinct()
    )
    few = (F.col("m_x") <= GROUP_PAIRS) & (F.col("m_y") <= GROUP_PAIRS)
    left, right = member.select(F.col("gid").alias("gid_x"), F.col("id").alias("a")), member.select(
        F.col("gid").alias("gid_y"), F.col("id").alias("b")
    )
    within = member.where((F.col("m") > 1) & (F.col("m") <= GROUP_PAIRS))
    class_pairs = cut(
        pairs.where(few).join(left, "gid_x").join(right, "gid_y").select("a", "b")
        .union(
            within.select("gid", F.col("id").alias("a")).join(within.select("gid", F.col("id").alias("b")), "gid")
            .where("a < b").select("a", "b")
        )
        .distinct()
    )

    tied = (
        listed.where(F.col("len") > SHORT_LIST).select(F.col("first").alias("a"), F.col("gid").alias("b"))
        .union(pairs.where(~few).select("gid_x", "gid_y"))
        .union(member.where(F.col("m") > GROUP_PAIRS).select(F.col("gid"), F.col("id")))
    )
    cluster = components(tied)
    # Every class of a group that is in a cluster, each once.
    in_cluster = cut(
        member.join(cluster, member["gid"] == cluster["node"]).select("id", "n", "component")
        .dropDuplicates(["id", "component"])
    )
    wanted = class_pairs.select(F.col("a").alias("id")).union(class_pairs.select("b")).union(in_cluster.select("id"))
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    sets = (
        read.where("doc_id IS NOT NULL").select("doc_id", "text", _bit(F.col("doc_id")).alias("bit"))
        .mapInArrow(_set_maker(bitmap), "id long, shingles array<long>")
        .where(F.size("shingles") > 0)
    )

    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(
        F.col("id").alias("b"), F.col("shingles").alias("sb")
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    pair_links = (
        class_pairs.join(one, "a").join(two, "b")
        .withColumn("shared", shared)
        .where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent)
        .select("a", "b")
    )
    size = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES)
    ).cast("int").alias("blocks")
    # A unit holds a band of sizes and the next: sets of a link are in the same band or neighbours.
    step = math.log(max(100 / percent, 1.0001)) * (1 + 1e-9)
    large = in_cluster.groupBy("component").agg(size).where("blocks > 1").select("component", F.lit(True).alias("large"))
    banded = (
        in_cluster.join(large, "component", "left")
        .withColumn("band", F.when(F.col("large"), F.floor(F.log("n") / F.lit(step))).otherwise(F.lit(0)).cast("int"))
        .withColumn("unit", F.explode(F.when(F.col("large"), F.array(F.col("band") - 1, "band")).otherwise(F.array("band"))))
    )
    # Without rows of its own band, a unit's other band is in the next unit whole.
    units = (
        banded.groupBy("component", "unit").agg(size, F.max(F.col("band") == F.col("unit")).alias("own"))
        .where("own").drop("own")
    )
    placed = (
        banded.join(units, ["component", "unit"])
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "component", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    block_links = (
        sets.join(placed, "id")
        .groupBy("component", "unit", "i", "j")
        .applyInPandas(_block_links(percent), "a long, b long")
    )
    by_class = some.select("doc_id", "n", "digest").join(classes.select("n", "digest", "id"), ["n", "digest"])
    repeated = (
        by_class.withColumn("lo", F.min("id").over(Window.partitionBy("doc_id")))
        .where("lo <> id").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    )
    links = cut(pair_links.union(block_links).union(repeated).distinct())
    membership = (
        by_class.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("class_id"))
        .union(
            profile.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").cast("long"), "doc_id")
        )
    )
    return membership, links


def linked_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest equal document), component_id."""
    membership, links = join_classes(docs, percent)
    found = components(links)
    return membership.join(found, membership["class_id"] == found["node"], "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
