"""The persisted indexes against full scans: the same rows, from fewer blocks, cells and buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cells, postings, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    common, rare = ["the", "of", "a"], [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        topic = rare[i // 100 * 20 : i // 100 * 20 + 20]
        words = [rng.choice(common if rng.random() < 0.5 else topic if rng.random() < 0.9 else rare) for _ in range(rng.randint(1, 60))]
        rows.append((i * 7, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (None, "w1"), (20_002, "W1, w1; w1!")]
    return spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["w1 w25", "the w44", "the of a", "w299 w3 nowhere", "nowhere", "", None, "w61 w62 w63 w64", "of"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('postings')}/index"
    for third in range(3):
        postings.append(corpus.filter(F.col("chunk_id") % 3 == third), path, buckets=32, parts=2)
    return path


@pytest.mark.parametrize("mode", ["or", "and"])
@pytest.mark.parametrize("k", [1, 5, 5000])
def test_posting_index_equals_the_scan(corpus, asked, index, k, mode):
    got = postings.search(index, asked, k, mode=mode, buckets=32).select("query_id", "chunk_id", "score", "rank")
    want = retrieval.sparse(corpus.filter("chunk_id IS NOT NULL"), asked, k, mode=mode).select("query_id", "chunk_id", "score", "rank")
    assert sorted(got.collect()) == sorted(want.collect())


def test_blocks_that_cannot_matter_stay_shut(asked, index):
    rows = postings.blocks(index, asked, 3, buckets=32).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("opened").alias("opened")).collect()
    by = {r["query_id"]: r for r in rows}
    assert by[7]["opened"] < by[7]["n"]
    assert sum(r["opened"] for r in rows) < 0.8 * sum(r["n"] for r in rows)


def test_bytes_read_fall_with_the_terms(spark, asked, index):
    def scanned(queries):
        rows = postings._opened(spark, index, postings._asked(queries), 32)
        return {r[0] for r in rows.select("bucket").distinct().collect()}, rows

    few, rows = scanned(asked.filter("query_id = 8"))
    assert len(few) == 1 and len(scanned(asked)[0]) > 8
    plan = rows.select("term", "top")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "postings" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_all_hits_without_k(corpus, asked):
    got = {(r["query_id"], r["chunk_id"], r["score"]) for r in retrieval.sparse(corpus.filter("chunk_id IS NOT NULL"), asked, None, mode="and").collect()}
    want = {(r["query_id"], r["chunk_id"], r["score"]) for r in retrieval.sparse(corpus.filter("chunk_id IS NOT NULL"), asked, 5000, mode="and").collect()}
    assert got == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_cell_index_equals_the_scan(spark, tmp_path, monkeypatch, blocks):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((20, 16))
    x = np.concatenate([c + 0.1 * rng.standard_normal((60, 16)) for c in centers])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(40)] + [(6000, [0.0] * 16), (6001, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, (centers[i % 20] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(12)], "query_id bigint, vec array<double>")
    if blocks > 1:
        monkeypatch.setattr(cells, "QUERY_BYTES", 12 * 16 * 8 // blocks)
    fitted = cells.fit(d, 24)
    path = str(tmp_path)
    for half in (0, 1):
        cells.append(d.filter(F.col("doc_id") % 2 == half), path, fitted)
    got, seen = cells.search(spark, path, q, 7)
    want = retrieval.dense(d, q, 7, "doc_id")
    key = lambda f: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["sim"], 8)) for r in f.collect())
    assert key(got) == key(want)
    assert seen["pairs_scored"] < 0.5 * seen["pairs"] and seen["rows"] == 1240
    everything, _ = cells.search(spark, path, q, 2000)
    assert everything.count() == 12 * 1240
    none, _ = cells.search(spark, path, q.limit(0), 7)
    assert none.count() == 0
