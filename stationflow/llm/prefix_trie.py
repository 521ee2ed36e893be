"""Conversation prefix trie by truncation peeling.

1. Turns become cells of fixed size (digest of role and text, bytes of the text); texts
   go no further. A conversation is the row of its cells, its *path*.
2. Equal paths merge: these are the nodes at which conversations end.
3. Peeling starts at the greatest depth. The nodes of a depth are the conversations that
   end there and the stripped nodes of the depth below, grouped by path. Each group is
   aggregated into its node, emitted, stripped of its last cell and handed on as a child.
   So a node is found and summed up in the same pass, and a prefix that a third of all
   conversations share is pre-aggregated in every task.
4. Paths beyond ``DEEP`` turns would need a pass per turn. There a path is stripped
   at once down to where it meets another one; passes count meetings, not turns.
5. The members that end at a node are hashed as sorted text: range-partitioned runs
   of ids are written as pieces, so the task that hashes a node reads few rows.

Defined results: rows without a conv_id belong to no conversation; NULL role or text is
empty; turns of equal number are ordered by role, then by digest of role and text; a
repeated row is a further turn; conv_id % 5 has the sign of conv_id; an empty table has no
node, not even a root; other columns are not read. The cells of one conversation
(24 bytes a turn) must fit a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import cut, shuffle_partitions

FAMILY = 5
MOST_SHARED = 8
CELL = 24
DEEP = 64
PIECE_BYTES = 1 << 16
BATCH_BYTES = 4 << 20

_COLUMNS = ("key", "parent", "depth", "conv", "n", "kids", "leaves", "saved")
NODE = "key string, parent string, depth long, conv long, n long, kids long, leaves long, saved long"
CHAIN = "path binary, conv long, n long, kids long, leaves long, saved long"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _written(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _batched(rows: Iterator[tuple[int, tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """(bytes, row) pairs as batches of bounded size."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight + 64
        if size >= BATCH_BYTES:
            yield _written(held, names, types)
            held, size = [], 0
    if held:
        yield _written(held, names, types)


def shared_turns(conv: int) -> int:
    """How many first turns a conversation takes over from the first of its family."""
    return zlib.crc32(str(conv).encode()) % (MOST_SHARED + 1)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns (family, conv_id, digest, bytes), the family's first conversation first, to paths."""

    def rows() -> Iterator[tuple[int, tuple]]:
        family = conv = None
        first: list[bytes] = []
        path, own, h = bytearray(), 0, 0
        for f, c, digest, size in _rows_of(batches):
            if c != conv:
                if conv is not None:
                    yield len(path), (conv, bytes(path))
                if f != family:
                    family, first = f, []
                conv, own, h = c, 0, shared_turns(c)
                path = bytearray(b"".join(first[:h])) if c != f else bytearray()
            cell = digest + struct.pack(">Q", size)
            own += 1
            if c == f and own <= MOST_SHARED:
                first.append(cell)
            if c == f or own > h:
                path += cell
        if conv is not None:
            yield len(path), (conv, bytes(path))

    yield from _batched(rows(), ["conv", "path"], [pa.int64(), pa.binary()])


def paths(conversations: DataFrame) -> DataFrame:
    """``(conv, path)``: every conversation rebuilt, turnless ones included."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
        "conv_id",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        "turn",
        role.alias("role"),
    )
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ordered = turns.repartition(shuffle_partitions(conversations.sparkSession), "family").sortWithinPartitions(*order)
    return ordered.select("family", "conv_id", "digest", "size").mapInArrow(_rebuilt, "conv long, path binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (key, conv) to runs of ids as text."""

    def rows() -> Iterator[tuple[int, tuple]]:
        key, first, parts, size = None, 0, [], 0
        for k, conv in _rows_of(batches):
            if k != key or size >= PIECE_BYTES:
                if parts:
                    yield size, (key, first, ",".join(parts).encode())
                key, first, parts, size = k, conv, [], 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
        if parts:
            yield size, (key, first, ",".join(parts).encode())

    yield from _batched(rows(), ["key", "first", "ids"], [pa.string(), pa.int64(), pa.binary()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces to the hash of each node's whole list."""

    def rows() -> Iterator[tuple[int, tuple]]:
        key, held = None, None
        for k, _, ids in _rows_of(batches):
            if k != key:
                if held is not None:
                    yield 0, (key, held.hexdigest())
                key, held = k, hashlib.sha256(ids)
            else:
                held.update(b"," + ids)
        if held is not None:
            yield 0, (key, held.hexdigest())

    yield from _batched(rows(), ["key", "ends"], [pa.string(), pa.string()])


def ends(found: DataFrame) -> DataFrame:
    """``(key, ends)``: the hash of the ids that end at a node, in ascending order."""
    n = shuffle_partitions(found.sparkSession)
    members = found.select(F.md5("path").alias("key"), "conv")
    pieces = members.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        _pieces, "key string, first long, ids binary"
    )
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, ends string")


def _summed(contributions: DataFrame) -> DataFrame:
    """Group by path; a node without children is a leaf, and saves its own last text n - 1 times."""
    last = F.conv(F.hex(F.expr("substring(path, -8, 8)")), 16, 10).cast("long")
    nodes = contributions.groupBy("path").agg(
        F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved"))
    )
    own = F.when(F.length("path") > 0, (F.col("n") - 1) * last).otherwise(F.lit(0))
    return nodes.withColumns(
        {"leaves": F.when(F.col("kids") == 0, F.lit(1)).otherwise(F.col("leaves")), "saved": F.col("saved") + own}
    )


def _depth() -> Column:
    return (F.length("path") / CELL).cast("long")


def _handed_on(nodes: DataFrame) -> DataFrame:
    """What a node adds to its parent."""
    shorter = F.expr(f"substring(path, 1, length(path) - {CELL})")
    return nodes.where("length(path) > 0").select(shorter.alias("path"), "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved")


def _named(nodes: DataFrame) -> DataFrame:
    parent = F.when(F.length("path") > 0, F.md5(F.expr(f"substring(path, 1, length(path) - {CELL})")))
    return nodes.withColumns({"key": F.md5("path"), "parent": parent, "depth": _depth()}).select(*_COLUMNS)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each path its own key, and the key of each of its prefixes from ``DEEP`` turns on."""

    def rows() -> Iterator[tuple[int, tuple]]:
        for (path,) in _rows_of(batches):
            whole, depth = hashlib.md5(path).digest(), len(path) // CELL
            running = hashlib.md5(path[: DEEP * CELL])
            for i in range(DEEP, depth + 1):
                if i > DEEP:
                    running.update(path[(i - 1) * CELL : i * CELL])
                yield 32, (whole, i, running.copy().digest(), i == depth)

    yield from _batched(
        rows(), ["whole", "depth", "prefix", "own"], [pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    )


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a path from its end down to just above its meeting, as NODE rows."""

    def rows() -> Iterator[tuple[int, tuple]]:
        for path, conv, n, kids, leaves, saved, meeting in _rows_of(batches):
            running = hashlib.md5(path[: meeting * CELL])
            keys = [running.hexdigest()]
            for i in range(meeting, len(path) // CELL):
                running.update(path[i * CELL : (i + 1) * CELL])
                keys.append(running.copy().hexdigest())
            for i in range(len(path) // CELL, meeting, -1):
                if i < len(path) // CELL:
                    saved += (n - 1) * int.from_bytes(path[i * CELL - 8 : i * CELL], "big")
                yield 128, (keys[i - meeting], keys[i - meeting - 1], i, conv, n, kids, leaves, saved)
                kids = 1

    types = [pa.string(), pa.string(), *[pa.int64()] * 6]
    yield from _batched(rows(), list(_COLUMNS), types)


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths cut at their meeting, with what their tails hand on."""

    def rows() -> Iterator[tuple[int, tuple]]:
        for path, conv, n, _, leaves, saved, meeting in _rows_of(batches):
            for i in range(meeting + 1, len(path) // CELL):
                saved += (n - 1) * int.from_bytes(path[i * CELL - 8 : i * CELL], "big")
            yield meeting * CELL, (path[: meeting * CELL], conv, n, 1, leaves, saved)

    yield from _batched(rows(), ["path", "conv", "n", "kids", "leaves", "saved"], [pa.binary(), *[pa.int64()] * 5])


def _peel_deep(chains: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Peel paths beyond ``DEEP`` turns: the nodes there, and what is handed on at ``DEEP``."""
    emitted, done = [], []
    while True:
        done.append(chains.where(_depth() <= DEEP))
        open_ = chains.where(_depth() > DEEP)
        if open_.isEmpty():
            return emitted, cut(_union(done))
        # Contributions that wait at one path are kept apart until nothing deeper passes through it.
        marks = cut(open_.select("path").distinct().mapInArrow(_marks, "whole binary, depth long, prefix binary, own boolean"))
        shared = marks.groupBy("depth", "prefix").count().where("count > 1").select("depth", "prefix")
        met = marks.join(shared, ["depth", "prefix"]).groupBy("whole").agg(
            F.max(F.when(~F.col("own"), F.col("depth"))).alias("meeting"), F.max("own").alias("waits")
        )
        known = open_.withColumn("whole", F.unhex(F.md5("path"))).join(met, "whole", "left")
        known = cut(known.withColumns({"waits": F.coalesce("waits", F.lit(False)), "meeting": F.coalesce("meeting", F.lit(DEEP)).cast("long")}))
        free = _summed(known.where("NOT waits").select("path", "conv", "n", "kids", "leaves", "saved"))
        meeting = known.select("path", "meeting").distinct()
        ready = cut(free.join(meeting, "path").select("path", "conv", "n", "kids", "leaves", "saved", "meeting"))
        emitted.append(ready.mapInArrow(_tails, NODE))
        waiting = known.where("waits").select("path", "conv", "n", "kids", "leaves", "saved")
        chains = cut(ready.mapInArrow(_stripped, CHAIN).union(waiting))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = cut(paths(conversations))
    zero = F.lit(0).cast("long")
    ended = cut(
        found.groupBy("path").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
        .select("path", "conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"))
    )
    deepest = ended.agg(F.max(_depth())).first()[0]
    emitted: list[DataFrame] = []
    if deepest is not None and deepest > DEEP:
        emitted, ended = _peel_deep(ended)
        deepest = DEEP
    handed: DataFrame | None = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = ended.where(_depth() == depth)
        nodes = cut(_summed(here if handed is None else here.unionByName(handed)))
        emitted.append(_named(nodes))
        handed = _handed_on(nodes)
    if not emitted:
        emitted = [_named(_summed(ended))]
    nodes = cut(_union(emitted).join(ends(found), "key", "left"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
