"""Offset-mapped token counts: encode whole documents once, then share tokens out to sections.

A byte-level vocabulary covers every byte of a text, so token lengths give exact
offsets; they become character spans by counting the bytes that start a character. A
section is a span of characters of its document; sections of one document are ordered
and do not overlap. Tokens and sections are joined as intervals by binary search of the
section ends, so no pair of a token and a section it misses is made.

Rule for every token: its first character is the one that holds its first byte, and it
counts for the section that holds this character; so the tokens of a split character all
count where the character lies, and the line counts of a text add up to its tokens. A
token whose first character lies in no section counts for none.

Nothing is shuffled for lines; other sections meet their document by doc_id.

Defined results: a NULL or empty text has one empty line with 0 tokens; a document
without sections in a given section table gives no rows; NULL or empty spans get 0
tokens; a NULL doc_id is kept for lines and matches nothing in a section table;
repeated rows are counted one by one; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches
from stationflow.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long"
_KINDS = [pa.int64()] * 6


def token_lengths(tokens: Encoder) -> np.ndarray:
    """Bytes per id: the vocabulary writes each byte as one character."""
    vocabulary = tokens.tokenizer.get_vocab()
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, k in vocabulary.items():
        lengths[k] = len(token)
    return lengths


def character_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that hold the first bytes, and ends (exclusive), of tokens with these byte lengths."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    starts_character = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts_character)))
    return before[start + 1] - 1, before[stop]


def share_out(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; sections ordered and apart."""
    section = np.searchsorted(stops, first, side="right")
    inside = section < len(stops)
    section, first, end = section[inside], first[inside], end[inside]
    inside = starts[section] <= first
    section, end = section[inside], end[inside]
    n = np.bincount(section, minlength=len(stops))
    crossing = np.bincount(section[end > stops[section]], minlength=len(stops))
    return n, crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines; a line feed belongs to the line it ends."""
    ends = np.fromiter((k + 1 for k, c in enumerate(text) if c == "\n"), np.int64) if "\n" in text else np.empty(0, np.int64)
    stops = np.append(ends, len(text))
    return np.concatenate(([0], stops[:-1])), stops


def _counter(path: str | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        lengths = token_lengths(tokens)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            ids: list = []
            for doc_id, text, encoded, spans in zip(
                batch.column(0).to_pylist(), texts, tokens.ids(texts), given, strict=True
            ):
                data = text.encode("utf-8", "surrogatepass")
                first, end = character_spans(data, lengths[np.frombuffer(encoded, np.uint32)])
                if batch.num_columns > 2:
                    spans = sorted(spans or (), key=lambda s: (s["start"] or 0, s["stop"] or 0, s["section"]))
                    starts = np.array([s["start"] or 0 for s in spans], np.int64)
                    stops = np.array([s["stop"] or 0 for s in spans], np.int64)
                    names = np.array([s["section"] for s in spans], np.int64)
                else:
                    starts, stops = lines(text)
                    names = np.arange(len(stops))
                n, crossing = share_out(first, end, starts, stops)
                ids.extend([doc_id] * len(stops))
                for part, values in zip(parts, (names, starts, stops, n, crossing), strict=True):
                    part.append(values)
            columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts)]
            yield pa.record_batch(columns, names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return count


def tokens_by_line(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per line of every document: doc_id, section, start, stop, n_tokens, n_crossing."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(_counter(tokenizer), SCHEMA)


def tokens_by_section(docs: DataFrame, sections: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The same for given sections (doc_id, section, start, stop), in characters, not overlapping."""
    bounded_batches(docs.sparkSession)
    spans = sections.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.collect_list(
            F.struct(
                F.col("section").cast("long").alias("section"), F.col("start").cast("long").alias("start"),
                F.col("stop").cast("long").alias("stop"),
            )
        ).alias("spans")
    )
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id")
    return read.select("doc_id", "text", "spans").mapInArrow(_counter(tokenizer), SCHEMA)
