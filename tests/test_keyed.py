"""Keyed tables against plain dictionaries, and folds over long documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunks
from lodestar.sources.keyed import KeyedTable, stream_into


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_writes_in_any_order_and_again(spark, tmp_path):
    """Upserts, deletes and replays in random order: the greatest batch of a key wins."""
    rng = random.Random(3)
    kinds = spark.createDataFrame([], "doc_id bigint, idx int, text string").schema
    batches = {}
    for b in range(1, 7):
        batches[b] = [(rng.choice([None, *range(8)]), rng.randint(0, 2), f"{b}-{rng.randint(0, 99)}") for _ in range(rng.randint(1, 12))]
    want = {}
    for b in sorted(batches):
        for d, i, t in batches[b]:
            want[d, i] = max((want.get((d, i), (0, "")), (b, t)))
    order = [*batches, *rng.sample(sorted(batches), 3)]
    rng.shuffle(order)
    table = KeyedTable(spark, f"{tmp_path}/t", kinds, ["doc_id", "idx"], buckets=4)
    for b in order:
        table.upsert(spark.createDataFrame(batches[b], kinds), b)
    read = lambda: {(r["doc_id"], r["idx"]): r["text"] for r in table.read().collect()}
    assert read() == {k: t for k, (_, t) in want.items()}
    table.delete(spark.createDataFrame([(1,), (2,), (77,)], "doc_id bigint"), 9)
    for b in order[:3]:
        table.upsert(spark.createDataFrame(batches[b], kinds), b)
    assert read() == {k: t for k, (_, t) in want.items() if k[0] not in (1, 2)}
    table.upsert(spark.createDataFrame([(1, 0, "back")], kinds), 10)
    assert read()[1, 0] == "back"
    table.upsert(spark.createDataFrame([], kinds), 11)
    assert len(read()) == len([k for k in want if k[0] not in (1, 2)]) + 1


def test_first_write_wins(spark, tmp_path):
    kinds = spark.createDataFrame([], "k string, v int").schema
    table = KeyedTable(spark, f"{tmp_path}/t", kinds, ["k"], buckets=2)
    for b, rows in ((2, [("a", 2), ("b", 2)]), (3, [("a", 3), ("c", 3)]), (1, [("b", 1)]), (2, [("a", 2)])):
        table.insert_ignore(spark.createDataFrame(rows, kinds), b)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", 2), ("b", 1), ("c", 3)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("v"))
    table = KeyedTable(spark, path, rows.schema, ["doc_id"], buckets=16)
    table.upsert(rows, 1)
    before = files(path)
    table.upsert(rows.filter("doc_id = 5").withColumn("v", F.lit(2)), 2)
    assert len({f.rsplit("/", 2)[-2] for f in before ^ files(path)}) == 1
    before = files(path)
    assert table.update(F.col("v") == 2, {"v": F.lit(3)}, 3) == 1
    assert len({f.rsplit("/", 2)[-2] for f in before ^ files(path)}) == 1
    before = files(path)
    assert table.update(F.col("v") == 2, {"v": F.lit(3)}, 4) == 0 and files(path) == before
    assert table.read().filter("v = 3").count() == 1 and table.read().count() == 400


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i) for k in range(i, 5)], "k int, v int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table = KeyedTable(spark, f"{tmp_path}/t", source.schema, ["k"], buckets=2)
    for _ in range(2):
        stream_into(source, table, f"{tmp_path}/state").awaitTermination()
    assert {r["k"]: r["v"] for r in table.read().collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}


def folded(rows, least=200, most=1000):
    """The rule of merged sections, in plain Python."""
    out = {}
    for d, _, page, title, text in sorted(rows, key=lambda r: (r[0], r[1])):
        text = text or ""
        cell = " | " in text or (len(text) < 30 and 2 * sum(not (c.isalpha() or c.isspace()) for c in text) >= max(1, len(text)))
        mine = out.setdefault(d, [])
        if mine and not cell and not mine[-1][3] and page is not None and mine[-1][0] == page and len(mine[-1][2]) < least and len(mine[-1][2]) + 1 + len(text) <= most:
            mine[-1] = (page, title or mine[-1][1], mine[-1][2] + "\n" + text, False)
        else:
            mine.append((page, title, text, cell))
    return sorted((d, i, *x[:3]) for d, xs in out.items() for i, x in enumerate(xs))


@pytest.mark.parametrize("batch", [10_000, 3])
def test_sections_by_the_rule(spark, batch):
    rng = random.Random(batch)
    rows = []
    for d in range(25):
        for i in range(rng.randint(1, 40)):
            text = rng.choice([None, "", "a | b", "12.5 %", "word " * rng.randint(1, 60), "x" * rng.randint(1, 990)])
            rows.append((d, i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, f"t{i}"]), text))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        d = spark.createDataFrame(rows, "doc_id bigint, idx int, page int, title string, text string").repartition(5)
        got = sorted((tuple(r) for r in chunks.merged(d).collect()), key=lambda r: r[:2])
    finally:
        spark.conf.set(key, before)
    assert got == folded(rows)
    assert chunks.merged(d.limit(0)).count() == 0


def test_a_document_of_ten_million_characters(spark):
    """One document of 100,000 sections is folded batch by batch."""
    d = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("idx"), (F.col("id") / 1000).cast("int").alias("page"), F.lit(None).cast("string").alias("title"), F.repeat(F.lit("word "), 20).alias("text"))
    out = chunks.merged(d).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.max(F.char_length("text")).alias("most")).first()
    assert out["most"] <= 1000 and out["chars"] == 100 * 100_000 + 100_000 - out["n"] and out["n"] < 60_000
