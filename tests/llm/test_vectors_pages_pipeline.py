"""Archives, nearest neighbours, the pipeline, and the registered queries against their SQL."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect, difference
from stationflow.llm import legacy_archive, prefix_forest

FOLDER = "/root/testdata/sf0.001"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_pages_through_both_archive_kinds(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\nhttp://a.b 1.2.3.4 20200101000000 text/html 3\n<p>é🙂</p>"
    rows = [(1, "http://a b/c", tricky), (2, None, None), (3, "u", ""), (None, "u", tricky), (5, "u", tricky), (5, "u", tricky), (4, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = legacy_archive.archived_pages(pages.repartition(3), folder=str(tmp_path / "a")).collect()
    assert len(out) == len(rows) and all(r.payload_ok for r in out)
    data, empty = tricky.encode(), b""
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=str)
    assert got == sorted([
        (1, len(data), sha(data), "response", None), (5, len(data), sha(data), "revisit", 1), (5, len(data), sha(data), "revisit", 1),
        (None, len(data), sha(data), "revisit", 1), (2, 0, sha(empty), "response", None), (3, 0, sha(empty), "revisit", 2),
        (4, 300_000, sha(b"y" * 300_000), "response", None),
    ], key=str)
    kept = legacy_archive.archived_pages(pages, min_bytes=len(data) + 1, folder=str(tmp_path / "b"))
    assert kept.where("record_type = 'revisit'").count() == 0
    assert legacy_archive.archived_pages(pages.limit(0), folder=str(tmp_path / "c")).count() == 0
    read = legacy_archive.read_warc(spark, str(tmp_path / "a" / "warc")).where("page_id = 1").first()
    assert bytes(read.payload) == data and read.date == "2020-01-01T00:00:00Z"


def test_arc_versions_and_members():
    v1 = b"filedesc://f 0.0.0.0 20200101000000 text/plain 9\n1 0 me\nX\n\n\nhttp://a b 1.2.3.4 20010203040506 text/html 4\nabcd\nno header\n"
    v2 = b"filedesc://f 0.0.0.0 20200101000000 text/plain 200 - - 0 f 9\n2 0 me\nX\n\nhttp://c 1.2.3.4 200102030405 text/plain 200 - - 7 f 3\nx\ny\n"
    one = list(legacy_archive.arc_records(gzip.compress(v1[:60]) + gzip.compress(v1[60:])))
    assert [(r["uri"], r["payload"], r["date"]) for r in one] == [("http://a b", b"abcd", "2001-02-03T04:05:06Z")]
    two = list(legacy_archive.arc_records(v2))
    assert [(r["uri"], r["mime"], r["payload"], r["date"]) for r in two] == [("http://c", "text/plain", b"x\ny", "2001-02-03T04:05:00Z")]


def brute(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good.setdefault((i, tuple(v)), np.array(v, float))
    out = {}
    for (i, _), q in good.items():
        if i % 100 == 0:
            near = sorted({(float(np.sqrt(((q - v) ** 2).sum())), j) for (j, _), v in good.items() if j != i})
            out[i] = near[:k]
    return out


def test_forest_finds_the_nearest(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(1200)]
    rows += [(2000 + i, rows[100][1]) for i in range(40)]  # one vector many times
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [None] * 8), (None, rows[0][1]), (3005, [1.0] * 3), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = prefix_forest.nearest(table, F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    assert {r.query_id for r in got} == set(want)
    by = {q: sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q) for q in want}
    hits = 0
    for q, near in want.items():
        assert [r for r, _, _ in by[q]] == list(range(1, 11))
        assert [(s, v) for _, s, v in by[q]] == sorted((s, v) for _, s, v in by[q])
        hits += sum(s <= near[-1][0] + 1e-12 for _, s, _ in by[q])
    assert hits >= 0.9 * 10 * len(want)
    assert [v for _, _, v in by[100]] == list(range(2000, 2010))
    few = prefix_forest.nearest(table.where("vec_id < 4"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert prefix_forest.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("deviation", [0.01, 0.00001])
def test_forest_inside_a_dense_cluster(spark, deviation):
    """A third of all vectors in one tight cluster, all different."""
    random_, n = np.random.default_rng(4), 9000
    x = random_.standard_normal((n, 64))
    inside = np.arange(n) % 3 == 0
    x[inside] = random_.standard_normal(64) + deviation * random_.standard_normal((inside.sum(), 64))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in prefix_forest.nearest(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {True: [], False: []}
    for q in range(0, n, 100):
        distance = ((x - x[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        recall[bool(inside[q])].append(len(set(np.argsort(distance)[:10].tolist()) & found[q]) / 10)
    assert np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9


def test_search_array_prefers_long_prefixes():
    keys = np.sort(np.array([0b0000100001, 0b0000100010, 0b0001000001, 0b1111100000], np.int64))
    q, place = prefix_forest.search_array(keys, np.array([0b0000100011], np.int64), 2)
    assert sorted(place.tolist()) == [0, 1] and set(q.tolist()) == {0}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    unique = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    from test_documents import brute_components

    best = brute_components([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id for r in unique} == {c for _, c in best.values()}
    clean = corpus_pipeline.personal_data(spark, docs, FOLDER)
    assert clean.count() == len(rows) and clean.where("text RLIKE '[a-z0-9.]+@[a-z0-9]+[.]com'").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    with_null = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, with_null, FOLDER).collect()
        stage(spark, docs.limit(0), FOLDER).collect()


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= ids and all(r.offset + r.length <= 2048 for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, connect(FOLDER).sql(contract.oracle_sql()[name]).df()) is None
