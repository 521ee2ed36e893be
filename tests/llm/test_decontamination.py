"""Benchmark decontamination against a plain version, and removal."""

import hashlib
import random
import re

import pytest
from cases import HARD, docs_of, hard, none  # noqa: F401

from stationflow.llm import decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = re.findall(WORD, folded(text))
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    lengths = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = re.findall(WORD, folded(text))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def items_of(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")

    return build


def ordered(rows):
    return sorted(rows, key=str)


def made_up():
    rnd = random.Random(5)
    words = ["Ab", "c", "Éa", "ñ", "x1", "wörd", "漢", "the", "q"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 10, 14, 30])))) for k in range(12)]
    items += [(3, "a second text of item three"), (None, "an item that has no id at all"), (90, None), (100, items[4][1]), (9, "!! --")]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for k in range(40)]
    docs += [(200, "Before, " + ", ".join(items[5][1].split(" ")) + "; after"), (201, "AN ITEM, that has no: ID at all.")]
    docs += [(202, "ÉA éa " * 8), docs[3], docs[3]]
    return docs, items


@pytest.mark.parametrize("rows", [200_000, 3])
def test_scan_equals_a_plain_version(docs_of, items_of, monkeypatch, rows):
    """The second run has more windows than are broadcast."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    docs, items = made_up()
    got = decontamination.scan(docs_of(docs + HARD), items_of(items)).collect()
    assert ordered(map(tuple, got)) == ordered(plain(docs + HARD, items))


def test_odd_tables(hard, none, items_of):
    rows = decontamination.scan(hard, items_of([])).collect()
    assert len(rows) == len(HARD) and not any(r.contaminated for r in rows)
    assert decontamination.scan(none, items_of([(1, "one")])).count() == 0


def test_removal(docs_of, items_of):
    items = items_of([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")])
    docs = docs_of([
        (1, "Start: One, two three four five six seven eight nine TEN. end"), (2, "a short  Item, here; short item"),
        (3, "(clean)  text"), (4, None), (5, "short item"), (6, "short-item short item rest"),
    ])
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert spans == {1: "Start: . end", 2: "a , here; ", 3: "(clean)  text", 4: None, 5: "", 6: " rest"}
    left = decontamination.decontaminate(docs, items, remove="documents")
    assert {r.doc_id for r in left.collect()} == {3, 4} and left.columns == docs.columns
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, remove="all")


def test_word_pattern_is_one_set(spark):
    """Separators stand one by one (ranges cost several times as much) and cut as the ranges do."""
    assert "-" not in decontamination.WORD + decontamination.BETWEEN
    texts = ["".join(map(chr, range(lo, lo + 512))) for lo in (*range(0, 0xD800, 512), 0x1F400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", decontamination.normal_words("text").alias("w")).collect():
        assert r.w == re.findall(WORD, folded(r.text))
