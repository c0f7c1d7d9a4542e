"""The paged source against the tables that it reads."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual, StringContains

from lodestar.sources.paged import PagedReader, PagedSource, _Table


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    path = f"{tmp_path_factory.mktemp('paged')}/t"
    rows = spark.range(-2500, 7000, 3).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), (F.col("id") % 7).cast("string").alias("s"), F.array("id").alias("a"), F.timestamp_seconds(F.abs("id")).alias("at"))
    rows.repartition(4).write.parquet(path)
    yield path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_full_scan_in_pages(spark, paged):
    got = spark.read.format("paged").option("path", paged).option("key", "k").option("page", 100).option("run", 7).load()
    want = spark.read.parquet(paged)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.rdd.getNumPartitions() == 15
    few = spark.read.format("paged").option("path", paged).option("key", "k").option("columns", "s,k").load()
    assert few.columns == ["s", "k"] and few.count() == want.count()


@pytest.mark.parametrize("where", ["k > 100 AND k <= 450", "k = 2", "k >= 6990", "k < -9999", "s = '3'", "k < 0 AND s = '2'", "k > 10 OR k < 0", "k IS NULL", "s LIKE '%4%'", "k = 5 AND k = 2"])
def test_filters(spark, paged, where):
    got = spark.read.format("paged").option("path", paged).option("key", "k").load().filter(where)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.read.parquet(paged).filter(where).collect()))


def test_a_pushed_filter_reads_fewer_pages(paged):
    table = _Table({"path": paged, "key": "k", "page": "100", "run": "2"})
    whole, some = PagedReader(table, table.schema()), PagedReader(table, table.schema())
    left = list(some.pushFilters([GreaterThan(("k",), 100), LessThanOrEqual(("k",), 450), EqualTo(("s",), "3"), IsNotNull(("k",)), left_over := StringContains(("s",), "3")]))
    assert left == [left_over]
    assert len(whole.partitions()) == 49 and [(p.low, p.high) for p in some.partitions()] == [(101, 200), (200, 400), (400, 451)]


def test_the_same_rows_as_a_stream(spark, paged, tmp_path):
    source = spark.readStream.format("paged").option("path", paged).option("key", "k").load()
    run = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert first == spark.read.parquet(paged).filter("k IS NOT NULL").count()
    spark.createDataFrame([(10_000 + i, "x", [1]) for i in range(5)], "k bigint, s string, a array<bigint>").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(paged)
    run = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == first + 5


@pytest.mark.parametrize(("name", "key"), [("documents", "doc_id"), ("embeddings", "vec_id"), ("orders", "o_orderkey")])
def test_given_tables(spark, name, key):
    spark.dataSource.register(PagedSource)
    got = spark.read.format("paged").option("path", f"{SF}/{name}.parquet").option("key", key).load()
    want = spark.read.parquet(f"{SF}/{name}.parquet")
    assert got.columns == want.columns and got.exceptAll(want.select([F.col(c).cast(t) for c, t in got.dtypes])).count() == 0 and got.count() == want.count()
