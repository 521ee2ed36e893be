"""Operators on documents: defined results for odd rows, and brute force on made-up texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import HARD, docs_of, hard, none  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationflow.llm import (
    components, license_digest, license_texts, mixing, packing, pii, prefix_join, quality_ledger, suffix_dedup,
    suffix_sort, token_spans, tokens,
)
from stationflow.llm.tokens import Encoder

HARD_ROWS = 11


def made_up(n, seed=3):
    """Texts with exact and near copies, shared passages and repeats."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    out = []
    for k in range(n):
        kind = rnd.random()
        if out and kind < 0.15:
            text = rnd.choice(out)
        elif out and kind < 0.5:
            parts = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(1, 3)):
                parts[rnd.randrange(len(parts))] = rnd.choice(words)
            text = " ".join(parts)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90)))
            if rnd.random() < 0.3:
                text += "\n" + passage + " " + rnd.choice(words)
        out.append(text)
    return list(enumerate(out))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    best = {i: i for i in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return {i: (len(sets[i]), best[i]) for i in sets}


@pytest.mark.parametrize("short,group,block", [(64, 8, 1024), (2, 1, 8)])
def test_prefix_join_equals_brute_force(docs_of, monkeypatch, short, group, block):
    """The second run sends nearly everything through clusters and small blocks."""
    monkeypatch.setattr(prefix_join, "SHORT_LIST", short)
    monkeypatch.setattr(prefix_join, "GROUP_PAIRS", group)
    monkeypatch.setattr(prefix_join, "BLOCK_DOCS", block)
    pairs = made_up(120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_join.linked_components(docs_of(pairs)).collect()}
    assert got == brute_components(pairs)


def test_prefix_join_of_odd_rows(hard, none):
    rows = prefix_join.linked_components(hard).collect()
    assert len(rows) == HARD_ROWS
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 2, None), (6, 3, 6), (7, 3, 6), (5, 1, 5)} <= got
    assert prefix_join.linked_components(none).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 100: 90}


def test_ledger_of_odd_rows(hard, none):
    rows = {r.doc_id: r for r in quality_ledger.decide(quality_ledger.ledger(hard)).collect()}
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[1].base_failed, rows[1].kept) == (0, 0, True, False)
    assert (rows[5].n_words, rows[5].n_repeat_words, rows[5].base_failed) == (30_000, 30_000, True)
    assert rows[4].n_words == 5 and rows[8].word_chars == 20_000
    assert quality_ledger.ledger(none).count() == 0


def test_ledger_measures(docs_of):
    pairs = made_up(40) + [(99, "a b c d e f a b c d e g\na b\na b\n \n \n#*$")]
    got = {r.doc_id: r for r in quality_ledger.ledger(docs_of(pairs)).collect()}
    for i, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {p for k, x in enumerate(windows) if seen[x] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_policies_and_ablation(docs_of):
    entries = quality_ledger.ledger(docs_of([(1, "few"), (2, "a good line of ten words or more stands here today"), (3, "% " * 40)]))
    kept = {r.doc_id for r in quality_ledger.decide(entries, "v1").where("kept").collect()}
    assert kept == {2}
    assert {r.doc_id for r in quality_ledger.decide(entries, "base").where("kept").collect()} == {2}
    found = {r.rule: (r.failed, r.rejected_alone) for r in quality_ledger.ablation(entries, "v1").collect()}
    assert found["few_words"] == (1, 1) and found["many_symbols"] == (1, 0) and found["repeated_words"] == (1, 0)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(docs_of):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("a@.1 2+-(9)é0") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [
        "mail a.b@c.de, x@y.z.w_q@r.st é 1.2.3.4.5.6.7.8 300.1.1.1 01.002.0255.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (724) 555-7214 +12 3", "9" * 5000, "@" * 50, "a@b" * 50, "🙂 a@b.cd 🙂 +49 30 1234567", None, "",
    ]
    rows = pii.find_spans(docs_of(list(enumerate(texts)))).collect()
    for r in rows:
        assert [(s.kind, s.start, s.stop) for s in r.base] == base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_wide_spans_are_learned_and_masked(docs_of):
    """Spelled-out addresses near address words, among many plain ones, are added."""
    texts = [f"please mail bob{k}@site.com today" for k in range(60)]
    texts += [f"please mail bob{k} [at] site.com today" for k in range(20)]
    texts += ["order 4111 1111 1111 1112 was sent", "nothing here"]
    rows = {r.doc_id: r for r in pii.find_spans(docs_of(list(enumerate(texts))), keep=("doc_id", "text")).collect()}
    assert [s.kind for s in rows[70].spans] == [0] and not rows[70].base
    assert not rows[81].spans
    out = pii.find_spans(docs_of([(1, "a a@b.cd, b 1.2.3.4!"), (2, None)]), keep=("doc_id", "text")).select(
        "doc_id", pii.masked(F.col("text"), F.col("spans")).alias("t")
    )
    assert {r.doc_id: r.t for r in out.collect()} == {1: "a [EMAIL], b [IP]!", 2: None}


def test_pii_of_odd_rows(hard, none):
    rows = pii.find_spans(hard).collect()
    assert len(rows) == HARD_ROWS and not any(r.spans for r in rows)
    assert pii.find_spans(none).count() == 0


def test_encoder_equals_the_tokenizer():
    rnd = random.Random(1)
    encoder = Encoder()
    for _ in range(400):
        texts = ["".join(rnd.choice("ab1É.,!'s \n\t_²-(%  \x1c漢é\r<|>") for _ in range(rnd.randint(0, 20))) for _ in range(3)]
        for text, ids in zip(texts + [t + " <|endoftext|>" for t in texts], encoder.ids(texts + [t + " <|endoftext|>" for t in texts]), strict=True):
            assert list(np.frombuffer(ids, np.uint32)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.merger is not None


def check_packing(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    seen = Counter()
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = packing.piece_starts(len(ids), capacity)
        for k, (a, b) in enumerate(zip(pieces, [*pieces[1:], len(ids)], strict=True)):
            seen[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert seen == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    return len(by)


def test_packing(hard, none, docs_of):
    check_packing(packing.pack(hard).collect(), HARD, 2048)
    pairs = made_up(200)
    rows = packing.pack(docs_of(pairs), capacity=128).collect()
    least = max(sum(r.length for r in rows) / 128, sum(r.length > 64 for r in rows))
    assert check_packing(rows, pairs, 128) <= 2 + 1.05 * least
    assert packing.pack(none).count() == 0


def test_packer_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 5, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]


def brute_removed(pairs):
    data = {k: (t or "").encode() for k, (_, t) in enumerate(pairs)}
    n = suffix_dedup.LENGTH
    seen = Counter(d[a : a + n] for d in data.values() for a in range(len(d) - n + 1))
    out = []
    for k, d in data.items():
        gone = np.zeros(len(d) + 1, int)
        for a in range(len(d) - n + 1):
            if seen[d[a : a + n]] > 1:
                gone[a] += 1
                gone[min(a + n, len(d))] -= 1
        mask = gone.cumsum()[:-1] > 0
        spans = int(np.diff(np.concatenate(([0], mask.astype(int)))).clip(0).sum())
        kept = bytes(b for b, g in zip(d, mask, strict=True) if not g)
        out.append((pairs[k][0], len(d), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [65_536, 3])
def test_suffix_dedup_equals_brute_force(docs_of, monkeypatch, large):
    """The second run sends nearly all edges through window hashes."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    pairs = made_up(60) + [(100, "ab" * 300), (101, "z" * 500), (102, None), (None, "q" * 199), (103, "é" * 150)]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs_of(pairs)).collect()), key=str)
    assert got == brute_removed(pairs)


def test_suffix_dedup_of_odd_rows(hard, none):
    assert suffix_dedup.remove_repeats(hard).count() == HARD_ROWS
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_deep_shallow_sorting():
    rnd = random.Random(2)
    for _ in range(200):
        base = bytes(rnd.choice(b"ab") for _ in range(60))
        texts = [base[: rnd.randint(0, 60)] + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 25))]
        order, shared = suffix_sort.deep_shallow(texts)
        placed = [texts[k] for k in order]
        assert placed == sorted(texts) and sorted(order) == list(range(len(texts)))
        assert shared == [0, *(suffix_sort.common_prefix(a, b) for a, b in zip(placed, placed[1:], strict=False))]


def test_equal_windows_small_and_large_agree():
    rnd = random.Random(4)
    n = suffix_dedup.LENGTH
    for _ in range(40):
        lefts = [bytes(rnd.choice(b"ab") for _ in range(6)) for _ in range(2)]
        rights = [bytes(rnd.choice(b"ab") for _ in range(n)) for _ in range(2)]
        before, after, low = [], [], []
        for _ in range(rnd.randint(2, 12)):
            high, lowest = rnd.randint(3, 6), rnd.randint(0, 3)
            right = rnd.choice(rights)
            cut = rnd.choice([n, n - 2, n - 5])
            before.append(rnd.choice(lefts)[-high:])
            after.append((right[:cut] + b"c" * (n - cut))[: n - lowest])
            low.append(lowest)
        seen = Counter()
        for lo, b, a in zip(low, before, after, strict=True):
            for i in range(lo, len(b) + 1):
                seen[(i, (b[len(b) - i :] + a)[:n])] += 1
        for (lo, b, a), ranges in zip(zip(low, before, after, strict=True), suffix_dedup.equal_windows(low, before, after), strict=True):
            got = {i for x, y in ranges for i in range(x, y + 1)}
            assert got == {i for i in range(lo, len(b) + 1) if seen[(i, (b[len(b) - i :] + a)[:n])] > 1}


def test_token_spans(hard, none, docs_of, spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pairs = HARD + made_up(20)
    got = defaultdict(list)
    for r in token_spans.tokens_by_line(docs_of(pairs)).collect():
        got[r.doc_id].append((r.section, r.start, r.stop, r.n_tokens))
    want = defaultdict(list)
    for i, text in pairs:
        found = tokenizer.encode(text or "", add_special_tokens=False)
        starts, stops = token_spans.lines(text or "")
        own = Counter()
        character = [k for k, c in enumerate(text or "") for _ in c.encode()]
        at = 0
        for token in found.tokens:
            # A byte-level token has a character for each byte; it counts where its first byte lies.
            own[int(np.searchsorted(stops, character[at], side="right"))] += 1
            at += len(token)
        want[i] += [(k, int(a), int(b), own[k]) for k, (a, b) in enumerate(zip(starts, stops, strict=True))]
    for i in want:
        assert sorted(got[i]) == sorted(want[i]), i
    sections = spark.createDataFrame([(6, 1, 0, 9), (6, 2, 9, 100), (77, 1, 0, 1)], "doc_id long, section long, start long, stop long")
    rows = token_spans.tokens_by_section(hard, sections).collect()
    assert len(rows) == 4 and {(r.section, r.n_tokens) for r in rows} == {(1, 2), (2, 5)}
    assert token_spans.tokens_by_line(none).count() == 0


def test_white_space_that_words_need():
    """The set of characters is Python's white space, and pairs and ends count as before."""
    plain = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z")
    for c in map(chr, range(0x110000)):
        assert tokens.plain_spaces(f"a{c}b") == (c in " \n" or not c.isspace())
    for text in map("".join, itertools.product("a \n\t", repeat=4)):
        assert tokens.plain_spaces(text) == (not plain.search(text))


def test_known_words_are_looked_up_once():
    """A line with one new word looks only that word up again."""

    class Counted(dict):
        again = 0

        def __getitem__(self, word):
            self.again += 1
            return super().__getitem__(word)

    encoder = Encoder()
    known = "the cat sat on a mat\nand the cat sat"
    first = encoder.ids([known])
    encoder.spaced = Counted(encoder.spaced)
    assert encoder.ids([known]) == first and encoder.spaced.again == 0
    text = known + " zyqxlo on a mat"
    assert encoder.ids([text]) == [encoder._whole(text)] and encoder.spaced.again == 1


def test_tokens_of_split_characters(docs_of, spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["안녕하세요 세계", "日本語", "🙂🙃", "日本\n語 한국어\n🙂 plain é\n", "漢字\n漢字"]
    whole = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(whole) > sum(len(t) for t in texts)
    got = defaultdict(list)
    for r in token_spans.tokens_by_line(docs_of(list(enumerate(texts)))).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r.n_tokens)
    assert [sum(got[k]) for k in range(len(texts))] == whole
    # A line feed is one token and never merges with a letter, so each line counts alone.
    assert got[4] == [whole_of(tokenizer, "漢字") + 1, whole_of(tokenizer, "漢字")]
    each = spark.createDataFrame([(1, k, k, k + 1) for k in range(3)], "doc_id long, section long, start long, stop long")
    rows = token_spans.tokens_by_section(docs_of([(1, texts[1])]), each).collect()
    assert sum(r.n_tokens for r in rows) == whole[1] and min(r.n_tokens for r in rows) >= 1


def whole_of(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_license_digests(hard, none, docs_of):
    mit = license_texts.TEXTS["MIT"].replace("MIT License\n", "MIT LICENCE\n\nCopyright (c) 2020 Some One\n").replace("\n", "\r\n")
    pairs = [(1, mit), (2, mit + " more"), (3, "text\nlicensed under the  APACHE licence version 2 0\nend"), (4, "!!!"), (5, "a license line")]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in license_digest.scan(docs_of(pairs)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "Apache-2.0"), 4: (None, ""), 5: (None, "")}
    assert license_digest.scan(hard).count() == HARD_ROWS and license_digest.scan(none).count() == 0


def test_long_licenses_and_given_notices(docs_of, spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    pairs = [(k, license_texts.TEXTS[n].replace("\n", "\r\n")) for k, n in enumerate(names)]
    got = {r.doc_id: r.license_id for r in license_digest.scan(docs_of(pairs)).collect()}
    assert got == dict(enumerate(names))
    notice = "This program is free software under\nthe terms of the Own License\nas published by us."
    known = spark.createDataFrame(
        [("Own-1", notice, False), ("Own-2", "The whole Own text.", True), ("Own-3", "the WHOLE own text", True), ("Own-4", "", True)],
        "license string, text string, whole boolean",
    )
    pairs = [(1, f"x = 1\n# {notice.replace(chr(10), chr(10) + '# ')}\nend"), (2, "the whole own text"), (3, notice[:50]), (4, None), (5, "MIT\nLicensed under the MIT License.")]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in license_digest.scan(docs_of(pairs), known).collect()}
    assert got == {1: (None, "Own-1"), 2: ("Own-2", ""), 3: (None, ""), 4: (None, ""), 5: (None, "MIT")}


def test_mixing(docs_of, spark, hard, none):
    rnd = random.Random(8)
    pairs, labels = [], []
    for i in range(600):
        kind = rnd.choice(["good", "good", "good", "poor", "toxic"])
        marks = {"good": "fine", "poor": "%%%", "toxic": "rotten"}[kind]
        pairs.append((i, " ".join(rnd.choice(["tree", "house", "river", "stone", marks]) for _ in range(rnd.randint(15, 40)))))
        if i < 400:
            labels.append((i, int(kind == "good"), int(kind == "toxic")))
    table = spark.createDataFrame(labels + [(0, 0, 0), (None, 1, 0), (700, None, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs_of(pairs), table).collect()
    assert len(rows) == 600 and min(r.rate for r in rows) >= 0
    held_out = [(r, pairs[r.doc_id][1]) for r in rows if r.doc_id >= 400]
    right = sum((r.p_toxic > 0.5) == ("rotten" in t) for r, t in held_out)
    assert right >= 0.95 * len(held_out)
    mass = np.array([[r.rate * r.n_tokens * p for p in (r.p_good, r.p_poor, r.p_toxic)] for r in rows]).sum(axis=0)
    assert np.abs(mass / mass.sum() - [0.96, 0.03, 0.01]).max() < 0.01
    assert all(r.copies >= 1 for r in rows if r.p_good > 0.5)
    out = mixing.mixed_documents(docs_of(pairs), table)
    assert out.columns == docs_of(pairs).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    no_labels = mixing.mix(hard, table.limit(0)).collect()
    assert len(no_labels) == HARD_ROWS and {round(r.p_good, 6) for r in no_labels} == {round(1 / 3, 6)}
    assert mixing.mix(none, table).count() == 0


def soft_scores(spark, *parts):
    """Documents of 100 tokens: (how many, posteriors) by part."""
    rows = [(100, *p) for n, p in parts for _ in range(n)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], mixing.SCORES)


def rated_copies(scores):
    by_cell = scores.sparkSession.sparkContext.broadcast(mixing.fit_rates(scores, mixing.TARGETS))
    rated = scores.mapInArrow(mixing._rate_column(by_cell), f"{mixing.SCORES}, rate double")
    return rated.withColumn("copies", mixing._copies(F.col("rate"), F.col("doc_id"))).toPandas()


def test_copies_follow_the_rates(spark):
    scores = soft_scores(spark, (4000, (0.55, 0.40, 0.05)), (7200, (0.98, 0.01, 0.01)), (800, (0.30, 0.45, 0.25)))
    rows = rated_copies(scores)
    p = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    fitted, emitted = rows["rate"].to_numpy() @ p, rows["copies"].to_numpy() @ p
    assert np.abs(fitted / fitted.sum() - emitted / emitted.sum()).max() < 0.003
    assert (rows["rate"][rows["p_good"] >= 0.5] >= 1).all()
    some = spark.range(20_000).select(F.col("id"), (F.lit(0.8) + F.col("id") % 5 / 10).alias("rate"))
    mean = some.groupBy("rate").agg(F.avg(mixing._copies(F.col("rate"), F.col("id"))).alias("copies")).collect()
    assert all(abs(r.copies - r.rate) < 0.03 for r in mean)


@pytest.mark.parametrize("last", [(0.98, 0.01, 0.01), (0.02, 0.08, 0.90), (0.30, 0.45, 0.25)])
def test_soft_posteriors_are_fitted_to_the_end(spark, last):
    parts = [(1000, (0.45, 0.05, 0.50)), (1800, (0.90, 0.08, 0.02)), (200, last)]
    rows = rated_copies(soft_scores(spark, *parts))
    p = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    fitted = 100 * rows["rate"].to_numpy() @ p
    # Plain projected gradient over the parts, for very long.
    q, n = np.array([x for _, x in parts]), np.array([100 * k for k, _ in parts])
    mass, least = q * n[:, None], (q[:, 0] >= 0.5).astype(float)
    goal = np.array([0.96, 0.03, 0.01]) * mass[:, 0].sum() / 0.96
    scale, r = 1 / mass.sum(axis=0), np.ones(3)
    curve = np.linalg.norm(np.sqrt(scale)[:, None] * (mass.T @ q) * np.sqrt(scale), 2)
    for _ in range(200_000):
        r = np.maximum(least, r - q @ (scale * (r @ mass - goal)) / curve)
    assert np.abs(fitted - r @ mass).max() <= 2 * mixing.CLOSE * goal.sum()


def test_a_fit_that_does_not_end_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(soft_scores(spark, (100, (0.45, 0.05, 0.50)), (180, (0.90, 0.08, 0.02))), mixing.TARGETS)
