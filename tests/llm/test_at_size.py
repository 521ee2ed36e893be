"""What holds the cost of an operator down on larger tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.llm import prefix_forest, prefix_join


def test_full_buckets_keep_common_passages_out_of_the_prefixes(spark, monkeypatch):
    """Passages of 70 documents stand out from buckets that the corpus sizes, so no list is long."""
    rnd, rows = random.Random(5), []
    words = [f"w{k}" for k in range(4000)]
    passages = [[rnd.choice(words) for _ in range(10)] for _ in range(20)]
    for k in range(1500):
        own = [rnd.choice(words) for _ in range(50)]
        rows.append((k, " ".join(own + (passages[k % 20] if k < 1400 else []))))
    tied = []
    components = prefix_join.components
    monkeypatch.setattr(prefix_join, "SKETCH_BITS", 6)
    monkeypatch.setattr(prefix_join, "components", lambda links: tied.append(links.count()) or components(links))
    found = prefix_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(k, k) for k, _ in rows}
    assert tied[0] == 0


def test_bucket_numbers_as_steps(spark, monkeypatch):
    for numbers in ([], [0], [0, 0, 255, 254 + 255, 255 * 5, 255 * 5, 100_000], [254], [255], [510]):
        assert prefix_join.decoded(prefix_join.coded(np.diff(np.array(numbers, np.int64), prepend=0))).tolist() == numbers
    assert prefix_join.sketch_bits(0) == prefix_join.SKETCH_BITS
    assert prefix_join.sketch_bits(10 * 2**30) == 25 and prefix_join.sketch_bits(2**50) == prefix_join.SKETCH_MOST
    monkeypatch.setattr(prefix_join, "SKETCH_BITS", 6)
    monkeypatch.setattr(prefix_join, "SKETCH_FLUSH", 50)
    texts = [" ".join(f"{k % 7} {k % 11} {j}" for j in range(30)) for k in range(40)] + ["", None]
    counts = np.zeros(64, np.int64)
    for text in texts:
        np.add.at(counts, (prefix_join.shingle_set(text) >> np.uint64(58)).astype(np.int64), 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert (prefix_join.bucket_counts(docs) == (8 * np.log2(np.maximum(counts, 1))).astype(int)).all()


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_within_span_the_same_parts_as_all_pairs(percent):
    random_ = np.random.default_rng(6)
    base = [np.unique(random_.integers(0, 2000, random_.integers(1, 80))) for _ in range(25)]
    sets = []
    for s in base * 4:
        sets.append(np.unique(np.where(random_.random(len(s)) < 0.12, random_.integers(0, 2000, len(s)), s)))
    sets += base[:3]

    def parts(links):
        part = list(range(len(sets)))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return [part.index(p) for p in part]

    wanted = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
    ]
    found = prefix_join.links_within(sets, percent)
    assert parts(found) == parts(wanted) and {(max(p), min(p)) for p in found} <= set(wanted)


def test_search_array_takes_the_best_of_both_sides():
    random_ = np.random.default_rng(7)
    for n, most in ((1, 3), (50, 7), (300, 40), (40, 40)):
        keys = np.sort(random_.integers(0, 1 << int(random_.integers(5, 62)), n))
        wanted = np.concatenate((random_.integers(0, 1 << 62, 20), keys[:10], keys[-1:]))
        query, place = prefix_forest.search_array(keys, wanted, most)
        for k, w in enumerate(wanted):
            got = place[query == k]
            assert len(set(got.tolist())) == min(n, most) and got.min() >= 0 and got.max() < n
            length = [62 - int(x).bit_length() for x in keys ^ w]
            assert sorted(length[p] for p in got) == sorted(length)[-min(n, most) :]


def test_forest_in_many_blocks_and_passes(spark, monkeypatch, tmp_path):
    """No string and no candidate is written: what is, stays near the size of the vectors."""
    random_, n = np.random.default_rng(8), 3000
    x = random_.standard_normal((n, 16)).astype(np.float32)
    x[1::2] = x[:1] + 0.001 * x[1::2]
    monkeypatch.setattr(prefix_forest, "BLOCK", 700)
    monkeypatch.setattr(prefix_forest, "QUERIES", 13)
    monkeypatch.setattr(prefix_forest, "AT_ONCE", 5)
    made = []
    cut = prefix_forest.cut
    monkeypatch.setattr(prefix_forest, "cut", lambda df: made.append(cut(df)) or made[-1])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = prefix_forest.nearest(table, F.col("vec_id") % 100 < 2).collect()
    assert sum(df.count() for df in made) <= 2 * n
    assert len(rows) == 10 * 60 and len({(r.query_id, r.vec_id) for r in rows}) == 600
    wide, hits = x.astype(np.float64), 0
    for r in rows:
        assert r.vec_id != r.query_id
        assert r.score == pytest.approx(np.sqrt(((wide[r.vec_id] - wide[r.query_id]) ** 2).sum()), rel=1e-12)
        distance = ((wide - wide[r.query_id]) ** 2).sum(axis=1)
        hits += distance[r.vec_id] <= np.sort(distance)[10] * (1 + 1e-12)
    assert hits >= 0.9 * len(rows)


def test_nearest_of_floats_by_distances_in_doubles():
    random_ = np.random.default_rng(9)
    for scale in (1e-25, 1e-6, 1.0, 1e25):
        x = ((1 + 1e-5 * random_.standard_normal((500, 64))) * scale).astype(np.float32)
        score, found = prefix_forest._measured(x, x[3], np.arange(500), 11)
        apart = np.sqrt(((x.astype(np.float64) - x[3].astype(np.float64)) ** 2).sum(axis=1))
        assert found.tolist() == np.lexsort((np.arange(500), apart))[:11].tolist() and score.tolist() == apart[found].tolist()
