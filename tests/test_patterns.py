"""Many keys in many texts, and plans over facets, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import filters, patterns


def a_dictionary(n):
    rng = random.Random(n)
    keys = {"".join(rng.choice("abcde é") for _ in range(rng.randint(3, 9))) for _ in range(n)}
    texts = ["".join(rng.choice("abcde é") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "zzz"]
    return sorted(keys), texts


@pytest.mark.parametrize("block", [2 << 20, 20_000])
def test_a_dictionary_of_many_keys(spark, monkeypatch, block):
    """50,000 keys, in one automaton and in many, against `in`."""
    monkeypatch.setattr(patterns, "BLOCK_BYTES", block if block > 1 << 20 else 400_000)
    keys, texts = a_dictionary(80_000)
    assert len(keys) > 50_000
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame([(k,) for k in [*keys, keys[0], "", None]], "key string")
    got = {(r["id"], r["key"]) for r in patterns.contained(d, table, "id", F.col("text")).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) if t for k in keys if k in t}
    best = {r["id"]: r["key"] for r in patterns.longest(d, table, "id", F.col("text")).collect()}
    assert best == {i: min((k for j, k in got if j == i), key=lambda k: (-len(k), k)) for i in {i for i, _ in got}}
    assert patterns.contained(d, table.limit(0), "id", F.col("text")).count() == 0


def test_synonyms(spark):
    pairs = [("b", "y"), ("a", "x"), ("a", "b"), ("c", "z"), ("d", "w"), ("e", "v"), ("f", "u"), ("", "q"), (None, "q"), ("g", None)]
    d = spark.createDataFrame([(0, "a b"), (1, "abcdefg"), (2, None), (3, "q"), (4, "a x")], "id int, text string")
    table = spark.createDataFrame(pairs, "key string, word string")
    got = {r["id"]: r["w"] for r in patterns.synonyms(d, table, "text", "w").collect()}
    assert got == {0: ["x", "y"], 1: ["x", "y", "z", "w", "v"], 2: [], 3: [], 4: ["b"]}


def test_plans_by_trying_all(spark):
    """Every plan against every document; hot tags, ties in time, plans asked many times, and all kinds of plans."""
    rng = random.Random(12)
    day = datetime(2024, 1, 1)
    docs = [(i, f"{rng.choice(['Plan', 'report', 'Note'])} {rng.randint(0, 9)}", rng.sample(["hot", "a", "b", "c"], rng.randint(0, 3)) + (["hot"] if rng.random() < 0.6 else []), day + timedelta(hours=rng.randint(0, 400))) for i in range(300)]
    plans = []
    for i in range(90):
        start = (day + timedelta(days=rng.randint(0, 14))).date() if rng.random() < 0.5 else None
        end = start + timedelta(days=rng.randint(0, 6)) if start else None
        plans.append((i, start, end, rng.choice([None, [], ["hot"], ["hot", "a"], ["a", "hot"], ["b"], ["zz"]]), rng.choice([None, None, "plan", "REPORT 3", "nothing"])))
    d = spark.createDataFrame(docs, "doc_id bigint, title string, tags array<string>, created_at timestamp").repartition(3)
    p = spark.createDataFrame(plans, "ask_id int, start date, end date, tags array<string>, title string")
    got = {(r["ask_id"], r["place"]): r["doc_id"] for r in filters.by_plan(d, p, 5).collect()}
    want = {}
    for ask, start, end, tags, title in plans:
        fits = [(-at.timestamp(), i) for i, name, have, at in docs if set(tags or []) <= set(have) and (start is None or start <= at.date() < end) and (title or "").lower() in name.lower()]
        want |= {(ask, n): i for n, (_, i) in enumerate(sorted(fits)[:5], 1)}
    assert got == want


def test_a_hot_tag_meets_no_plan_whole(spark):
    """Rows of a facet and day are cut to k in each task before they are shuffled."""
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.array(F.lit("hot")).alias("tags"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"))
    facets = spark.createDataFrame([(["hot"], "")], "_tags array<string>, _title string")
    out = filters.newest_by_facet(d, facets, 5)
    assert out.count() == 5 and "WindowGroupLimit" in out._jdf.queryExecution().toString()
