"""Searches by scoring in the scan and by joining give the same hits, and agree with brute force."""

import random

import numpy as np
import pytest

from lodestar.operators import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    pool = ["der", "the", "of", "Zug", "bahn", "näher", "x1", "_a", "rare"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    chunks = [(i, text(rng.randint(0, 12)), [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(150)] + [(900, None, None), (901, "", [0.0] * 4)]
    queries = [(q, text(rng.randint(0, 4)) or "zzz", [rng.choice([-1.0, 1.0, 0.5]) for _ in range(4)]) for q in range(12)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string, vec array<double>").repartition(5)
    return chunks, queries, frame(chunks, "chunk_id"), frame(queries, "query_id")


@pytest.mark.parametrize("mode", ["or", "and"])
@pytest.mark.parametrize("most", [1_000_000, 0])
def test_sparse(corpus, monkeypatch, mode, most):
    chunks, queries, c, q = corpus
    monkeypatch.setattr(retrieval, "MAX_ASKED", most)
    want = []
    for i, t, _ in queries:
        asked = set(t.lower().split())
        scores = [(-sum(w in asked for w in (x or "").lower().split()), n) for n, x, _ in chunks if mode == "or" or asked <= set((x or "").lower().split())]
        want += [(i, n, -s, k + 1) for k, (s, n) in enumerate(sorted(x for x in scores if x[0])[:7])]
    got = retrieval.sparse(c, q, 7, mode=mode).select("query_id", "chunk_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_dense(corpus, monkeypatch):
    chunks, queries, c, q = corpus
    monkeypatch.setattr(retrieval, "ROWS", 13)
    want = []
    for i, _, v in queries:
        v = np.array(v)
        scores = [(-round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 9), n) for n, _, x in chunks if x is not None and np.linalg.norm(x) > 0]
        want += [(i, n, k + 1) for k, (_, n) in enumerate(sorted(scores)[:9])]
    got = retrieval.dense(c, q, 9).select("query_id", "chunk_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert retrieval.dense(c, q.limit(0), 9).count() == retrieval.sparse(c, q.limit(0), 9).count() == 0
