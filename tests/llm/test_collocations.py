"""Collocations against a plain count, and the summaries' guarantee."""

import random
import re
from collections import Counter

import numpy as np
from cases import HARD, docs_of, hard, none  # noqa: F401

from stationflow.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n int"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + s]) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    out = []
    for lang, own in f.items():
        found = []
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cands.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def made_up(n=150):
    rnd = random.Random(11)
    words = ["Ab", "c", "éa", "Ñ", "x1", "wörd", "漢", "the", "q", "of", "zz", "\x01", "\x0e"] + [f"w{k}" for k in range(60)]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " !? "]
    rows = []
    for k in range(n):
        parts = [rnd.choice(words[: rnd.choice([5, 73])]) + rnd.choice(gaps) for _ in range(rnd.randint(0, 120))]
        rows.append(("".join(parts) + (" the quick brown fox" if k % 3 else ""), rnd.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), rows[0], rows[0], ("very long " * 30_000, "xx"), ("y" * 100_000, "xx")]


def build(spark, rows):
    return spark.createDataFrame([(k, t, lang, "clash", 1) for k, (t, lang) in enumerate(rows)], DOCS)


def test_equals_a_plain_count(spark, monkeypatch):
    """Small buffers, parts and filters, so that all are cut and merged."""
    monkeypatch.setattr(collocations, "BUFFER_BYTES", 3_000)
    monkeypatch.setattr(collocations, "STEP_BYTES", 100)
    rows = made_up()
    got = collocations.collocations(build(spark, rows).repartition(5), top=50).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10, 50)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 4)
    rows = made_up(60)
    assert sorted(map(tuple, collocations.collocations(build(spark, rows)).collect())) == plain(rows, 10, 2000)


def test_odd_tables(hard, none):
    assert collocations.collocations(none).count() == 0
    got = {r.phrase: r for r in collocations.collocations(hard).collect()}
    # "word word word" holds all but one occurrence of "word word".
    assert set(got) == {"word word word"} and got["word word word"].a == 29_998


def test_equal_first_hashes_are_told_apart(spark, monkeypatch):
    """All phrases share the first hash; the second one keeps their counts apart."""
    first = collocations._Words.phrases

    def same(self, n, seed, which=0):
        g, at = first(self, n, seed, which)
        return (g if which else np.zeros_like(g)), at

    monkeypatch.setattr(collocations._Words, "phrases", same)
    rows = made_up(20)
    assert sorted(map(tuple, collocations.collocations(build(spark, rows)).collect())) == plain(rows, 10, 2000)


def test_summaries_lose_less_than_the_threshold():
    rnd = np.random.default_rng(1)
    keys = np.concatenate([rnd.integers(0, 20_000, 60_000), np.repeat(np.arange(50), 10)]).astype(np.uint32)
    rnd.shuffle(keys)
    summary = collocations.Summary(len(keys), 10)
    summary.capacity = len(keys) // 10 + 1  # the least that the guarantee allows
    for part in np.array_split(keys, 37):
        summary.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint32, np.uint64), strict=True)))
    true = Counter(keys.tolist())
    kept = set(summary.survivors().tolist())
    assert {k for k, c in true.items() if c >= 10} <= kept and summary.lost < 10
    assert len(summary.keys) <= summary.capacity
