"""Bounded-space online best-fit packing of token sequences.

Documents are encoded once, cut into pieces where they are longer than a sequence,
and packed by length alone. A packer holds at most ``open_bins`` open sequences, keyed
by free space: bit ``f`` of one integer says that a sequence with ``f`` free places is
open, so the best fit for a piece is the lowest set bit at or above its length. When
no sequence fits and all are open, the fullest is closed first. A piece goes out as
soon as it is placed, so a packer holds numbers only.

Pieces are dealt by hash to packers of about ``GROUP`` full sequences each; the number
of packers follows the tokens of the corpus, and each leaves at most a few sequences
half full. Pieces reach a packer in order of falling length, for which best fit wastes
least.

Defined results: a NULL or empty text is its closing id alone (one piece of one
token); repeated rows are packed one by one; a NULL doc_id is kept; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches, cut
from stationflow.llm.tokens import MOST_KEPT, encoder

CAPACITY = 2048
OPEN_BINS = 16_384
GROUP = 8_192
END = b"\0\0\0\0"


class Packer:
    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = self.begun = 0

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of this length."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            sequence, free = self.begun, self.capacity
            self.begun += 1
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.mask |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin: full ones, but for the first."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def _cutter(path: str | None, capacity: int, most_kept: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, most_kept)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(
                batch.column(0).to_pylist(), tokens.ids(batch.column(1).to_pylist()), strict=True
            ):
                ids += END
                n = len(ids) // 4
                starts = piece_starts(n, capacity)
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            yield pa.record_batch({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns, strict=True)})

    return pieces


def _packer(capacity: int, open_bins: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            sequences, offsets = [], []
            for g, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, Packer(capacity, open_bins)
                sequence, offset = packer.place(length)
                sequences.append((g << 40) + sequence)
                offsets.append(offset)
            batch = batch.drop_columns(["grp"])
            yield batch.append_column("sequence_id", pa.array(sequences, pa.int64())).append_column(
                "offset", pa.array(offsets, pa.int64())
            )

    return packed


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    most_kept: int = MOST_KEPT,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``most_kept`` bounds the words a Python worker remembers (some 200 bytes each).
    """
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(read.mapInArrow(_cutter(tokenizer, capacity, most_kept), schema))
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // (capacity * GROUP)))
    dealt = (
        pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
        .repartition(groups, "grp")
        .sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece")
    )
    return dealt.mapInArrow(_packer(capacity, open_bins), f"{schema}, sequence_id long, offset long")
