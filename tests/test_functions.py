"""Traps of the text, query, percentile and ranking functions, on small frames."""

from pyspark.sql import functions as F

from lodestar.functions import queries as Q
from lodestar.functions import text as T
from lodestar.operators import chunks, filters, joins, metering, metrics, percentiles, retrieval, sets, telemetry, windows


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_percentile_rules_differ(spark):
    df = spark.range(20).withColumn("x", F.col("id").cast("double"))
    got = percentiles.nearest(df, [], "x", p=0.95).first()
    assert (got["n"], got["p"]) == (20, 18.0)
    assert abs(df.agg(percentiles.linear("x", 0.95).alias("p")).first()["p"] - 18.05) < 1e-9
    assert percentiles.rounded(df, [], "x", p=0.5).first()["p"] == 10.0  # 9.5 rounds to the even 10
    assert df.agg(percentiles.continuous_int("x", 0.5).alias("p")).first()["p"] == 10
    assert df.filter("x < 0").agg(percentiles.continuous_int("x", 0.5).alias("p")).first()["p"] == 0


def test_kst_day_changes_at_15_utc(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 14:59:59' AS t UNION ALL SELECT timestamp'2024-01-01 15:00:00'")
    assert [str(r["d"]) for r in df.orderBy("t").select(telemetry.kst_day("t").alias("d")).collect()] == ["2024-01-01", "2024-01-02"]


def test_month_end_is_clamped(spark):
    got = spark.sql("SELECT date'2023-01-31' AS d").select(metering.next_month(F.col("d")).cast("string").alias("x")).first()["x"]
    assert got == "2023-02-28"


def test_nfc_joins_decomposed_letters(spark):
    assert one(spark, T.nfc(F.col("t")), t="각") == "각"


def test_watermarks_keep_their_spelling(spark):
    assert one(spark, T.watermarks(F.col("t")), t="Confidential and 대외비, CONFIDENTIAL") == ["CONFIDENTIAL", "Confidential", "대외비"]


def test_registration_numbers_need_a_real_date(spark):
    assert one(spark, T.pii_ranges(F.col("t")), t="900101-1234567 901301-1234567") == [(0, 14)]


def test_table_noise_and_prose(spark):
    noise = "\n".join(f"{i} | 1{i}3 | 4{i}6 | 78{i}" for i in range(6))
    assert one(spark, T.filtered_reason(F.col("t"), F.lit(1)), t=noise) == "table_noise"
    assert one(spark, T.filtered_reason(F.col("t"), F.lit(1)), t="이것은 표가 아니라 하나의 긴 문단이며, 여러 문장으로 이어지는 보통의 글이라서 검색에 남아 있어야 한다.") is None
    assert one(spark, T.filtered_reason(F.col("t"), F.lit(1)), t="  ") == "empty"
    assert one(spark, T.filtered_reason(F.col("t"), F.lit(1)), t="2,800") == "extreme_short"
    assert one(spark, T.filtered_reason(F.col("t"), F.lit(3)), t="Page header of it") == "header_footer"


def test_blanks_count_in_the_digit_ratio(spark):
    assert one(spark, T.digit_ratio(F.col("t")), t="1 2 3") == 5 / 3


def test_korean_sentences_split_and_keep_the_stop():
    text = "이것은 좋다. 다음 문장이다." * 60
    pieces = T.pack(text)
    assert len(pieces) > 1 and all(len(p) <= 1000 for p in pieces)
    assert pieces[0].endswith("다.")
    assert T.pack("짧다. 2025. 7. 9. 개정된 것") == ["짧다. 2025. 7. 9. 개정된 것"]


def test_unbalanced_quotes():
    assert T.is_unbalanced('say "so') and T.is_unbalanced("「열림") and not T.is_unbalanced("(x)")


def test_signals_and_decomposition(spark):
    fired = one(spark, Q.signals(F.col("q")), q="이력서와 포트폴리오 차이")
    assert fired == ["T1_cross_doc", "T2_compare"]
    assert one(spark, Q.needs_decomposition(Q.signals(F.col("q"))), q="이력서와 포트폴리오 차이")
    assert one(spark, Q.signals(F.col("q")), q="너랑 나랑 같이") == ["T7_multi_target"]
    assert abs(one(spark, Q.confidence(Q.signals(F.col("q"))), q="그거 왜") - 0.4) < 1e-9


def test_query_labels_by_priority(spark):
    label = lambda q, **k: one(spark, Q.label(F.col("q"), **k), q=q)
    assert label("구조도 표 비교") == "vision_diagram"
    assert label("3개월 요약") == "numeric_lookup"
    assert label("회의 안건", source=F.lit("협의 결과")) == "synonym_mismatch"
    assert label("뭐였지") == "fuzzy_memory"
    assert label("무엇", negative=F.lit(True)) == "out_of_scope"
    assert label("무엇") == "exact_fact"


def test_comments(spark):
    assert one(spark, Q.comment_label(F.col("c")), c="검색 결과 출처") == "source_issue"
    assert one(spark, Q.comment_label(F.col("c")), c="  ") == "other"


def test_dates(spark):
    at = lambda q: one(spark, Q.date_range(F.col("q"), "2024-01-31"), q=q)
    assert [str(x) for x in at("2024년 12월 자료")] == ["2024-12-01", "2025-01-01"]
    assert [str(x) for x in at("어제 문서")] == ["2024-01-30", "2024-01-31"]
    assert at("2024-13-01") is None and at("none") is None


def test_sub_queries(spark):
    assert one(spark, Q.sub_queries(F.col("a")), a='x ["a", " b "] y') == ["a", "b"]
    assert one(spark, Q.sub_queries(F.col("a")), a='["a"]') == []


def test_or_terms_drop_particles(spark):
    assert one(spark, retrieval.or_terms("q"), q="시트는 전폭은? 길이") == ["시트", "전폭", "길이"]


def test_cosine_policies(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) AS a, array(0.0D, 0.0D) AS z, array(1.0D) AS s")
    got = df.select(retrieval.cosine("a", "z").alias("n"), retrieval.cosine("a", "z", 0.0).alias("o"), retrieval.cosine("a", "s").alias("m"), retrieval.cosine("a", "a").alias("e")).first()
    assert got["n"] is None and got["o"] == 0.0 and got["m"] is None and got["e"] == 1.0


def test_cross_doc_scope_breaks_ties_by_id(spark):
    scores = {"A": [0.9, 0.8, 0.7, 0.1], "B": [0.85, 0.5, 0.3], "C": [0.9, 0.5, 0.4], "D": [0.9, 0.5, 0.4]}
    rows = [(1, d, f"{d}{i}", s) for d, v in scores.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, chunk_id string, rrf double")
    assert sorted(r["doc_id"] for r in retrieval.cross_doc_scope(df, 3).collect()) == ["A", "C", "D"]


def test_mmr_spreads(spark):
    vecs = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0, 0.01], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(1, i, 1.0 - i * 0.01, v) for i, v in enumerate(vecs)]
    got = retrieval.mmr(spark.createDataFrame(rows, "query_id int, id int, relevance double, vec array<double>"), 3, 0.5).collect()
    picked = [r["id"] for r in sorted(got, key=lambda r: r["place"])]
    assert picked[0] == 0 and len({0 if i < 3 else i for i in picked}) >= 2


def test_recall_and_no_labels(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    p = spark.createDataFrame([(1, r, i) for r, i in enumerate([1, 99, 2, 3], 1)] + [(2, 1, 5)], "query_id int, rank int, item int")
    labels = spark.createDataFrame([(1, i, 1.0) for i in (1, 2, 3)], "query_id int, item int, grade double")
    got = {r["query_id"]: r for r in metrics.per_query(q, p, labels, 2).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 1.0 and got[2]["recall"] == 0.0 and got[2]["ndcg"] == 0.0


def test_round_robin(spark):
    rows = [("Y", 0, 0.8), ("Y", 1, 0.6), ("Z", 0, 0.9), ("Z", 1, 0.7)]
    df = spark.createDataFrame(rows, "doc string, i int, s double")
    got = [(r["doc"], r["i"]) for r in windows.round_robin(df, "doc", [F.desc("s")]).orderBy("place").collect()]
    assert got == [("Y", 0), ("Z", 0), ("Y", 1), ("Z", 1)]


def test_adjacency_needs_a_neighbour_index(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.1), (1, 3, 0.1)], "d int, i int, s double")
    got = {r["i"]: r["s"] for r in windows.adjacent_boost(df, "d", "i", "s", 0.5).collect()}
    assert got == {0: 1.0, 1: 0.5, 3: 0.1}


def test_latest_hides_older_failures(spark):
    df = spark.createDataFrame([(1, "failed", 1), (1, "completed", 2)], "d int, status string, t int")
    assert windows.latest(df, "d", ["t"]).first()["status"] == "completed"


def test_snippet_and_highlights(spark):
    shown, marks = retrieval.snippet(F.col("t"), F.col("q"), 5)
    df = spark.createDataFrame([("xxxxxxxxxxABCabcyyyyyyyy", "abc"), ("none", "zz"), ("a.b a+b", "a+b")], "t string, q string")
    got = df.select("q", shown.alias("s"), marks.alias("m")).collect()
    assert got[0]["s"] == "…xxxxxABCabcyy…" and got[0]["m"] == [[6, 9], [9, 12]]
    assert got[1]["s"] == "none" and got[1]["m"] == []
    assert got[2]["m"] == [[4, 7]]


def test_toc_guard(spark):
    df = spark.createDataFrame([("[문서] 목차 설명\n\n본문 시작", "(vision) p.1", "질문"), ("차 례\n서론", "(vision) p.2", "질문"), ("차 례\n서론", "(vision) p.2", "목차 보여줘")], "t string, s string, q string")
    got = [r["x"] for r in df.select(retrieval.toc_guard(F.lit(1.0), F.col("t"), F.col("s"), F.col("q")).alias("x")).collect()]
    assert got == [1.0, 0.3, 1.0]


def test_short_sections_merge_on_one_page(spark):
    rows = [(1, 0, 1, "A", "short"), (1, 1, 1, None, "more"), (1, 2, 2, None, "next page"), (1, 3, 2, None, "a | b"), (1, 4, 2, None, "tail")]
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, page int, title string, text string")
    got = [r["text"] for r in chunks.merged(df).orderBy("idx").collect()]
    assert got == ["short\nmore", "next page", "a | b", "tail"]


def test_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 4), ("a", 5, 7), ("a", 9, 10)], "k string, s int, e int")
    assert sorted((r["s"], r["e"]) for r in sets.merged_intervals(df, "k", "s", "e").collect()) == [(0, 7), (9, 10)]


def test_dates_inclusive_and_half_open(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-05', timestamp'2024-01-10', timestamp'2024-01-10 00:00:01')) AS t")
    assert df.filter(filters.between_inclusive("t", "2024-01-05", "2024-01-10")).count() == 2
    assert df.filter(filters.between_half_open("t", "2024-01-05", "2024-01-10")).count() == 1


def test_empty_bucket_stays(spark):
    counts = spark.createDataFrame([(3600, 2)], "bucket_start bigint, n bigint")
    spine = joins.buckets(spark, "1970-01-01 00:00:00", "1970-01-01 02:00:00", 3600)
    assert sorted((r["bucket_start"], r["n"]) for r in joins.zero_fill(spine, counts, "bucket_start", ["n"]).collect()) == [(0, 0), (3600, 2), (7200, 0)]


def test_null_costs_are_left_out(spark):
    df = spark.createDataFrame([(0.01,), (None,), (0.02,)], "cost double")
    assert abs(df.agg(F.avg("cost")).first()[0] - 0.015) < 1e-12
