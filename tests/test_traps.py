"""Places where two engines, or a rule and its careless reading, come apart."""

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import filters, percentiles, retrieval, telemetry


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_whole_numbers_are_rounded_half_to_even(spark):
    d = spark.createDataFrame([(2,), (3,)], "x int")
    assert d.agg(percentiles.continuous_int("x", 0.5).alias("p")).first()["p"] == 2  # 2.5
    d = spark.createDataFrame([(3,), (4,)], "x int")
    assert d.agg(percentiles.continuous_int("x", 0.5).alias("p")).first()["p"] == 4  # 3.5
    assert d.limit(0).agg(percentiles.continuous_int("x", 0.5).alias("p")).first()["p"] == 0
    assert percentiles.rounded(spark.range(6).withColumnRenamed("id", "x"), [], "x", p=0.5).first()["p"] == 2  # place 2.5


def test_a_date_alone_is_its_midnight(spark):
    d = spark.createDataFrame([("2024-01-03 00:00:00",), ("2024-01-03 00:00:01",), ("2024-01-02 23:59:59",)], "t string").select(F.col("t").cast("timestamp"))
    assert d.filter(filters.between_inclusive("t", "2024-01-01", "2024-01-03")).count() == 2
    assert d.filter(filters.between_half_open("t", "2024-01-01", "2024-01-03")).count() == 1


def test_filters_after_the_cut_can_lose_matches(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(1, 7)], "query_id int, chunk_id int, rank int")
    wanted = F.col("chunk_id") > 4
    assert retrieval.pool(hits.filter("rank <= 4"), wanted, 2).count() == 0  # cut first, as the search does
    assert [r["chunk_id"] for r in retrieval.pool(hits, wanted, 2).collect()] == [5, 6]


def test_letters_of_all_scripts_are_word_characters(spark):
    assert one(spark, F.array_join(retrieval.terms("t"), "|"), t="가나1,_ab É-x") == "가나1|_ab|é|x"
    assert one(spark, T.digit_ratio(F.col("t")), t="가나12") == 0.5
    # A particle after a sum is no word boundary.
    assert one(spark, F.size(T.entities(F.col("t"))["amounts"]), t="1,000원은 1,000원") == 1


def test_positions_count_code_points(spark):
    text = "\U0001f600" * 300 + "Needle" + "é" * 300
    shown, marks = retrieval.snippet(F.col("t"), F.lit("needle"))
    assert one(spark, shown, t=text) == "…" + "\U0001f600" * 240 + "Needle" + "é" * 240 + "…"
    assert [list(m) for m in one(spark, marks, t=text)] == [[241, 247]]


def test_failed_documents_leave_counts_and_not_levels(spark):
    rows = [(1, "pdf", True, 10, 100.0, False), (2, "pdf", True, 10, 3000.0, True)]
    d = spark.createDataFrame(rows, "doc_id int, doc_type string, scan boolean, size_bytes bigint, received_ms double, failed boolean")
    assert d.filter("NOT failed").count() == 1
    level = {r["bucket"]: (r["sample_count"], r["pass_rate"]) for r in telemetry.slo(d).collect()}
    assert level["pdf_scan"] == (2, 0.5) and level["url"] == (0, None)


def test_single_precision_vectors_add_up_in_double(spark):
    d = spark.createDataFrame([([16777216.0, 1.0, 1.0], [1.0, 1.0, 1.0])], "a array<float>, b array<float>")
    got = d.select(retrieval.cosine("a", "b").alias("x")).first()["x"]
    assert abs(got - 16777218.0 / ((16777216.0**2 + 2) ** 0.5 * 3**0.5)) < 1e-15


def test_a_key_with_a_null_value_is_there(spark):
    d = spark.createDataFrame([('{"extract_skipped": null}',), ('{"extract_skipped": true}',), ("{}",)], "flags string")
    has = F.array_contains(F.json_object_keys("flags"), "extract_skipped")
    value = F.get_json_object("flags", "$.extract_skipped").isNotNull()
    assert [tuple(r) for r in d.select(has, value).collect()] == [(True, False), (True, True), (False, False)]
