"""Queries of filters, joins, windows, sorting and set operations over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import filters, joins, sets, windows
from lodestar.plans.catalog import query
from lodestar.sources import keyed, shared
from lodestar.sources.views import AS_OF, Views, sql

_LIVE = "deleted_at IS NULL"


@query("F1_tenant_live", sql(f"SELECT doc_id, title FROM docs WHERE user_id = 'src3' AND {_LIVE}"))
def f1(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), "src3").select("doc_id", "title")


@query("F1_all_tenants_live", sql(f"SELECT user_id, count(*) AS n FROM docs WHERE {_LIVE} GROUP BY user_id"))
def f1_all(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), None).groupBy("user_id").agg(F.count("*").alias("n"))


@query("F3_builders", sql("SELECT doc_id FROM docs WHERE doc_type IN ('pdf', 'url') AND user_id <> 'src1' AND received_ms IS NOT NULL"))
def f3(v: Views) -> DataFrame:
    return v.docs().filter(F.col("doc_type").isin("pdf", "url") & (F.col("user_id") != "src1") & F.col("received_ms").isNotNull()).select("doc_id")


@query("F4_tags_all_of", sql("SELECT doc_id FROM docs WHERE list_has_all(tags, ['en', 'src2'])"))
def f4(v: Views) -> DataFrame:
    return v.docs().filter(filters.has_all("tags", ["en", "src2"])).select("doc_id")


@query("F5_dates_inclusive", sql("SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-10'"))
def f5(v: Views) -> DataFrame:
    return v.docs().filter(filters.between_inclusive("created_at", "2024-01-05", "2024-01-10")).select("doc_id")


@query("F6_dates_half_open", sql("SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-10'"))
def f6(v: Views) -> DataFrame:
    return v.docs().filter(filters.between_half_open("created_at", "2024-01-05", "2024-01-10")).select("doc_id")


@query("F7_L6_title_ilike", sql(f"SELECT doc_id, title FROM docs WHERE title ILIKE '%SRC1%' AND {_LIVE} ORDER BY created_at DESC, doc_id LIMIT 20"))
def f7(v: Views) -> DataFrame:
    d = filters.tenant(v.docs(), None).filter(filters.title_contains("title", "SRC1"))
    return d.orderBy(F.desc("created_at"), "doc_id").limit(20).select("doc_id", "title")


@query("F11_not_failed", sql("SELECT user_id, count(*) AS n FROM docs WHERE NOT coalesce(failed, false) GROUP BY user_id"))
def f11(v: Views) -> DataFrame:
    return v.docs().filter(~F.coalesce("failed", F.lit(False))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("F13_rls_one_hop", sql(f"SELECT doc_id, count(*) AS n FROM chunks c WHERE EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = c.doc_id AND d.user_id = 'src3' AND {_LIVE}) GROUP BY doc_id"))
def f13(v: Views) -> DataFrame:
    return filters.owned(v.chunks(), filters.tenant(v.docs(), "src3"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("F14_rls_two_hops", sql(f"SELECT log_id FROM stage_logs l WHERE EXISTS (SELECT 1 FROM jobs j JOIN docs d ON d.doc_id = j.doc_id WHERE j.job_id = l.job_id AND d.user_id = 'src3' AND {_LIVE})"))
def f14(v: Views) -> DataFrame:
    jobs = filters.owned(v.jobs(), filters.tenant(v.docs(), "src3"), "doc_id")
    return filters.owned(v.stage_logs(), jobs, "job_id").select("log_id")


@query("F15_F16_title_and_type", sql("SELECT doc_id, title FROM docs WHERE (replace(title, '_', ' ') LIKE 'en src1%' OR replace(title, '_', ' ') LIKE 'fr src%' OR contains(replace(title, '_', ' '), 'src7 ')) AND doc_type IN ('docx', 'pdf')"))
def f16(v: Views) -> DataFrame:
    """Public titles, which come decomposed: by prefix or keyword once composed, with blanks for underscores."""
    public = filters.is_public(T.nfc(T.nfd(F.col("title"))), ["en src1", "fr src"], ["src7 "])
    return v.docs().filter(public & F.col("doc_type").isin("docx", "pdf")).select("doc_id", "title")


@query("F17_B14_stale_jobs", sql(f"SELECT job_id FROM jobs WHERE status = 'running' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 100 HOUR"))
def f17(v: Views) -> DataFrame:
    return filters.stale_jobs(v.jobs(), AS_OF, 100).select("job_id")


@query("F18_watchdog_update", sql(f"SELECT job_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 100 HOUR THEN 'failed' ELSE status END AS status FROM jobs"))
def f18(v: Views) -> DataFrame:
    return filters.fail_stale(v.jobs(), AS_OF, 100).select("job_id", "status")


@query("J1_chunks_documents", sql(f"SELECT d.user_id, count(*) AS n, sum(length(c.text))::BIGINT AS chars FROM chunks c JOIN docs d USING (doc_id) WHERE {_LIVE} GROUP BY d.user_id"))
def j1(v: Views) -> DataFrame:
    docs = filters.tenant(v.docs(), None).select("doc_id", "user_id")
    return v.chunks().join(docs, "doc_id").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("J4_enrichment", sql(f"SELECT c.chunk_id, d.title AS doc_title FROM (SELECT * FROM chunks WHERE chunk_idx = 0) c LEFT JOIN (SELECT * FROM docs WHERE {_LIVE}) d USING (doc_id)"))
def j4(v: Views) -> DataFrame:
    return v.chunks().filter("chunk_idx = 0").join(filters.tenant(v.docs(), None).select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left").select("chunk_id", "doc_title")


_LATEST = "SELECT doc_id, status, job_id, queued_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY queued_at DESC, job_id DESC) AS k FROM jobs) WHERE k = 1"


@query("J5_W4_list_with_latest_job", sql(f"SELECT d.doc_id, coalesce(n, 0) AS n_chunks, j.status FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id) LEFT JOIN ({_LATEST}) j USING (doc_id)"))
def j5(v: Views) -> DataFrame:
    counts = v.chunks().groupBy("doc_id").agg(F.count("*").alias("n"))
    latest = windows.latest(v.jobs(), "doc_id", ["queued_at", "job_id"]).select("doc_id", "status")
    return v.docs().join(counts, "doc_id", "left").join(latest, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), "status")


@query("J6_ownership_in_order", sql(f"SELECT doc_id, pos FROM (SELECT unnest([30, 3, 17, 43, 5]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos) r WHERE doc_id IN (SELECT doc_id FROM docs WHERE user_id IN ('src3', 'src5', 'src10') AND {_LIVE})"))
def j6(v: Views) -> DataFrame:
    asked = v.spark.createDataFrame([(d, i) for i, d in enumerate([30, 3, 17, 43, 5])], "doc_id bigint, pos int")
    own = filters.tenant(v.docs(), None).filter(F.col("user_id").isin("src3", "src5", "src10"))
    return filters.owned(asked, own, "doc_id").orderBy("pos").select("doc_id", "pos")


@query("J7_request_latest_job", sql(f"SELECT r.doc_id, j.status FROM (SELECT unnest(range(100, 200)) AS doc_id) r LEFT JOIN ({_LATEST}) j USING (doc_id)"))
def j7(v: Views) -> DataFrame:
    asked = v.spark.range(100, 200).withColumnRenamed("id", "doc_id")
    return asked.join(windows.latest(v.jobs(), "doc_id", ["queued_at", "job_id"]).select("doc_id", "status"), "doc_id", "left").select("doc_id", "status")


@query("W5_J8_latest_then_filter", sql(f"SELECT j.doc_id, j.status, d.title FROM ({_LATEST}) j JOIN docs d USING (doc_id) WHERE j.status IN ('queued', 'running', 'failed')"))
def w5(v: Views) -> DataFrame:
    latest = windows.latest(v.jobs(), "doc_id", ["queued_at", "job_id"]).filter(F.col("status").isin("queued", "running", "failed"))
    return latest.join(v.docs().select("doc_id", "title"), "doc_id").select("doc_id", "status", "title")


@query("J17_cache_hits_and_misses", sql("SELECT q.query_id, (e.query_id IS NOT NULL) AS hit, sha256(trim(q.text)) AS key FROM queries q LEFT JOIN (SELECT query_id FROM queries WHERE query_id % 3 = 0) e USING (query_id)"))
def j17(v: Views) -> DataFrame:
    q = v.queries().withColumn("key", joins.cache_key("text"))
    cache = q.filter("query_id % 3 = 0").select("key", "vec")
    return joins.cached(q.drop("vec"), cache, "key", "vec").select("query_id", F.col("vec").isNotNull().alias("hit"), "key")


@query("J18_S3_missing_pages", sql("SELECT d.doc_id, p AS page FROM (SELECT doc_id, unnest(range(1, 6)) AS p FROM docs) d LEFT JOIN (SELECT DISTINCT doc_id, page FROM chunks) c ON c.doc_id = d.doc_id AND c.page = d.p WHERE c.page IS NULL"))
def j18(v: Views) -> DataFrame:
    wanted = v.docs().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"))
    return sets.difference(wanted, v.chunks(), ["doc_id", "page"])


@query("J20_plan_of_user", sql("SELECT c_custkey AS user_id, CASE WHEN s.user_id IS NULL OR s.status = 'canceled' THEN 'free' ELSE s.plan END AS plan FROM customer LEFT JOIN subscriptions s ON s.user_id = c_custkey"))
def j20(v: Views) -> DataFrame:
    users = v.table("customer").select(F.col("c_custkey").alias("user_id"))
    return joins.plan_of(users, v.subscriptions()).select("user_id", "plan")


@query("J9_spine_zero_fill", sql("SELECT day::VARCHAR AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN (SELECT recorded_at::DATE AS day, count(*) AS n FROM search_log GROUP BY 1) l USING (day)"))
def j9(v: Views) -> DataFrame:
    counts = v.search_log().groupBy(F.to_date("recorded_at").alias("day")).agg(F.count("*").alias("n"))
    return joins.zero_fill(joins.days(v.spark, "2024-01-01", "2024-02-03"), counts, "day", ["n"]).select(F.col("day").cast("string").alias("day"), "n")


@query("J12_J13_fuzzy_titles", sql("""SELECT q, doc_id FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY tier, doc_id) AS k FROM (
  SELECT q, doc_id, CASE WHEN lower(title) = lower(q) THEN 1 WHEN regexp_replace(lower(title), '[^a-z0-9]', '', 'g') = regexp_replace(lower(q), '[^a-z0-9]', '', 'g') THEN 2 WHEN length(regexp_replace(lower(q), '[^a-z0-9]', '', 'g')) >= 8 AND (contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(q), '[^a-z0-9]', '', 'g')) OR (length(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) >= 8 AND contains(regexp_replace(lower(q), '[^a-z0-9]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]', '', 'g')))) THEN 3 END AS tier
  FROM docs, (SELECT unnest(['EN_src1_1', 'fr-src2-2', 'frsrc4_4', 'n_src10_10', '(final) es_src17_17 v2', 'src1', 'en_src3_3 de_src5_5', 'src16_16']) AS q)) WHERE tier IS NOT NULL) WHERE k = 1"""))
def j12(v: Views) -> DataFrame:
    asked = v.spark.createDataFrame([("EN_src1_1|fr-src2-2",), ("frsrc4_4|n_src10_10",), ("(final) es_src17_17 v2|src1",), ("en_src3_3 de_src5_5|src16_16",)], "titles string")
    return joins.fuzzy_titles(joins.split_titles(asked, "titles", "q"), v.docs().select("doc_id", "title"), "q").select("q", "doc_id")


@query("A5_count_by_type", sql(f"SELECT doc_type, count(*) AS n FROM docs WHERE {_LIVE} GROUP BY doc_type"))
def a5(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), None).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("A6_counters", sql("SELECT count(*) FILTER (failed) AS extract_skipped, count(*) FILTER (created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01') AS added_this_month, count(*) FILTER (created_at >= TIMESTAMP '2024-01-24') AS added_last_7d FROM docs WHERE deleted_at IS NULL"))
def a6(v: Views) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp")
    month = F.date_trunc("month", now)
    d = filters.tenant(v.docs(), None)
    return d.agg(
        F.count_if("failed").alias("extract_skipped"),
        F.count_if((F.col("created_at") >= month) & (F.col("created_at") < month + F.make_ym_interval(months=F.lit(1)))).alias("added_this_month"),
        F.count_if(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(7))).alias("added_last_7d"),
    )


@query("A7_A8_tag_top10", sql("SELECT tag, n FROM (SELECT unnest(tags) AS tag, count(*) AS n FROM docs WHERE deleted_at IS NULL GROUP BY 1) ORDER BY n DESC, tag LIMIT 10"))
def a8(v: Views) -> DataFrame:
    tags = filters.tenant(v.docs(), None).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("A9_type_frequency", sql("SELECT doc_type, n, row_number() OVER (ORDER BY n DESC, doc_type) AS place FROM (SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type)"))
def a9(v: Views) -> DataFrame:
    counts = v.docs().groupBy("doc_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "doc_type")))


@query("A45_exact_count", sql("SELECT count(*) AS n FROM docs WHERE user_id = 'src0' AND deleted_at IS NULL"))
def a45(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), "src0").agg(F.count("*").alias("n"))


@query("W6_top_chunks_of_doc", sql("SELECT doc_id, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_id) AS k FROM chunks) WHERE k <= 3"))
def w6(v: Views) -> DataFrame:
    c = v.chunks().withColumn("size", F.char_length("text"))
    return windows.top_per(c, "doc_id", [F.desc("size"), F.asc("chunk_id")], 3).select("doc_id", "chunk_id")


@query("W9_max_normalise", sql("SELECT doc_id, round(least(1.0, n / max(n) OVER ()), 4) AS relevance FROM (SELECT doc_id, count(*)::DOUBLE AS n FROM chunks GROUP BY doc_id)"))
def w9(v: Views) -> DataFrame:
    counts = v.chunks().groupBy("doc_id").agg(F.count("*").cast("double").alias("n"))
    return windows.max_normalised(counts, "n", "relevance").select("doc_id", "relevance")


@query("W10_R13_adjacent_rows", sql("""SELECT c.chunk_id, greatest(c.s, coalesce(max(n.s) * 0.5, 0)) AS score FROM (SELECT doc_id, chunk_idx, chunk_id, length(text)::DOUBLE AS s FROM chunks WHERE chunk_idx % 5 <> 4) c
  LEFT JOIN (SELECT doc_id, chunk_idx, length(text)::DOUBLE AS s FROM chunks WHERE chunk_idx % 5 <> 4) n ON n.doc_id = c.doc_id AND n.chunk_idx IN (c.chunk_idx - 1, c.chunk_idx + 1) GROUP BY c.chunk_id, c.s"""))
def w10(v: Views) -> DataFrame:
    c = v.chunks().filter("chunk_idx % 5 <> 4").withColumn("score", F.char_length("text").cast("double"))
    return windows.adjacent_boost(c, "doc_id", "chunk_idx", "score", 0.5).select("chunk_id", "score")


@query("W13_next_index", sql("SELECT doc_id, max(chunk_idx) + 1 AS next_idx FROM chunks GROUP BY doc_id"))
def w13(v: Views) -> DataFrame:
    return v.chunks().groupBy("doc_id").agg((F.max("chunk_idx") + 1).alias("next_idx"))


@query("W14_round_robin", sql("SELECT chunk_id, row_number() OVER (ORDER BY k, doc_id) AS place FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_id) AS k FROM chunks)"))
def w14(v: Views) -> DataFrame:
    c = v.chunks().select("doc_id", "chunk_id", F.char_length("text").alias("size"))
    return windows.round_robin(c, "doc_id", [F.desc("size"), F.asc("chunk_id")]).select("chunk_id", "place")


@query("W16_even_stride", sql("""SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS i, count(*) OVER () AS n FROM chunks WHERE length(text) >= 50)
  WHERE i IN (SELECT floor(n / 10.0 * g + n / 20.0) FROM (SELECT count(*) AS n FROM chunks WHERE length(text) >= 50), (SELECT unnest(range(0, 10)) AS g))"""))
def w16(v: Views) -> DataFrame:
    return windows.even_stride(v.chunks().filter(F.char_length("text") >= 50), "chunk_id", 10).select("chunk_id")


@query("W17_recent_failures", sql("SELECT event_id FROM search_log WHERE fallback_reason IS NOT NULL ORDER BY recorded_at DESC, event_id DESC LIMIT 10"))
def w17(v: Views) -> DataFrame:
    return v.search_log().filter("fallback_reason IS NOT NULL").orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(10).select("event_id")


@query("W18_sliding_24h_cost", sql("SELECT event_id, round(sum(CASE WHEN success THEN cost ELSE 0 END) OVER (PARTITION BY user_key ORDER BY floor(epoch(called_at))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 8) AS cost_24h FROM usage"))
def w18(v: Views) -> DataFrame:
    return windows.sliding_sum(v.usage().withColumn("paid", F.when(F.col("success"), F.col("cost")).otherwise(0.0)), "user_key", "called_at", "paid", 86400, "cost_24h").select("event_id", F.round("cost_24h", 8).alias("cost_24h"))


@query("L3_offset_page", sql(f"SELECT doc_id FROM docs WHERE {_LIVE} ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 40"))
def l3(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), None).orderBy(F.desc("created_at"), "doc_id").offset(40).limit(20).select("doc_id")


@query("L7_total_before_page", sql(f"SELECT doc_id, count(*) OVER () AS total FROM docs WHERE {_LIVE} ORDER BY created_at DESC, doc_id LIMIT 20"))
def l7(v: Views) -> DataFrame:
    live = filters.tenant(v.docs(), None)
    page = live.orderBy(F.desc("created_at"), "doc_id").limit(20).select("doc_id")
    return page.crossJoin(live.agg(F.count("*").alias("total")))


@query("S1_union_all_padded", sql("SELECT chunk_id, dense_rank, sparse_rank FROM (SELECT chunk_id, 1 AS dense_rank, NULL::INT AS sparse_rank FROM chunks WHERE chunk_idx = 0 UNION ALL SELECT chunk_id, NULL::INT, 2 FROM chunks WHERE chunk_idx = 1)"))
def s1(v: Views) -> DataFrame:
    c = v.chunks()
    a = c.filter("chunk_idx = 0").select("chunk_id", F.lit(1).alias("dense_rank"))
    return a.unionByName(c.filter("chunk_idx = 1").select("chunk_id", F.lit(2).alias("sparse_rank")), allowMissingColumns=True)


@query("S2_ordered_distinct", sql("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id"))
def s2(v: Views) -> DataFrame:
    return sets.ordered_distinct(v.table("conversations"), "conv_id", "role", "turn").select("conv_id", F.array_join("items", ",").alias("roles"))


@query("S4_overlap_test", sql("SELECT doc_id FROM docs WHERE list_has_any(tags, ['fr', 'src7'])"))
def s4(v: Views) -> DataFrame:
    return v.docs().filter(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("src7")))).select("doc_id")


@query("S5_interval_union", sql("""SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM (
  SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 7200 AS e FROM events))) GROUP BY user_id, island"""))
def s5(v: Views) -> DataFrame:
    e = v.table("events").select("user_id", F.unix_timestamp("ts").alias("s"), (F.unix_timestamp("ts") + 7200).alias("e"))
    return sets.merged_intervals(e, "user_id", "s", "e")


@query("N7_two_sources", sql("SELECT doc_id, origin FROM (SELECT doc_id, 'user' AS origin FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'auto' FROM docs WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0)"))
def n7(v: Views) -> DataFrame:
    d = v.docs().select("doc_id")
    return sets.prefer(d.filter("doc_id % 3 = 0").withColumn("origin", F.lit("user")), d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("auto")), "doc_id")


@query("N8_missing_references", sql("SELECT DISTINCT j.doc_id FROM jobs j WHERE j.doc_id NOT IN (SELECT doc_id FROM docs WHERE deleted_at IS NULL)"))
def n8(v: Views) -> DataFrame:
    return sets.difference(v.jobs().select("doc_id").distinct(), filters.tenant(v.docs(), None), ["doc_id"])


@query("N14_majority_label", sql("SELECT doc_id, status FROM (SELECT doc_id, status, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, status) AS k FROM jobs GROUP BY doc_id, status) WHERE k = 1"))
def n14(v: Views) -> DataFrame:
    return windows.majority(v.jobs(), "doc_id", "status").select("doc_id", "status")


@query("C15_C26_types_and_paths", sql("SELECT doc_id, 'user/' || user_id || '/' || sha256(text) || '.' || doc_type AS path FROM docs"))
def c26(v: Views) -> DataFrame:
    return v.docs().select("doc_id", joins.blob_path("user_id", "text", "doc_type").alias("path"))


@query("C19_upsert_latest", sql("SELECT doc_id, chunk_idx, max(version) AS version FROM (SELECT doc_id, chunk_idx, 1 AS version FROM chunks UNION ALL SELECT doc_id, chunk_idx, 2 FROM chunks WHERE doc_id % 2 = 0) GROUP BY 1, 2"))
def c19(v: Views) -> DataFrame:
    c = v.chunks().select("doc_id", "chunk_idx")
    return sets.upserted(c.withColumn("version", F.lit(1)), c.filter("doc_id % 2 = 0").withColumn("version", F.lit(2)), ["doc_id", "chunk_idx"]).select("doc_id", "chunk_idx", "version")


@query("C21_insert_ignore", sql("SELECT doc_id, origin FROM (SELECT doc_id, 'old' AS origin FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new' FROM docs WHERE doc_id % 2 <> 0)"))
def c21(v: Views) -> DataFrame:
    d = v.docs().select("doc_id")
    return sets.prefer(d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("old")), d.withColumn("origin", F.lit("new")), "doc_id")


def _written(v: Views, rows: DataFrame, keys: list[str], work) -> DataFrame:
    """What a keyed table holds after `work` has written to it."""
    path = shared.folder(v.spark, "keyed")
    try:
        work(table := keyed.KeyedTable(v.spark, path, rows.schema, keys, buckets=8))
        return shared.saved(table.read(), "rows")
    finally:
        shared.removed(v.spark, path)


@query("C19_upsert_written", sql("SELECT doc_id, chunk_idx, max(version) AS version FROM (SELECT doc_id, chunk_idx, 1 AS version FROM chunks UNION ALL SELECT doc_id, chunk_idx, 2 FROM chunks WHERE doc_id % 2 = 0) GROUP BY 1, 2"))
def c19_written(v: Views) -> DataFrame:
    """Chunks written, half of them again, and the first batch replayed, late."""
    one = v.chunks().select("doc_id", "chunk_idx", F.lit(1).alias("version"))
    two = one.filter("doc_id % 2 = 0").withColumn("version", F.lit(2))

    def work(table: keyed.KeyedTable) -> None:
        for batch, rows in ((1, one), (2, two), (2, two), (1, one)):
            table.upsert(rows, batch)

    return _written(v, one, ["doc_id", "chunk_idx"], work)


@query("C21_insert_ignore_written", sql("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM docs"))
def c21_written(v: Views) -> DataFrame:
    every = v.docs().select("doc_id", F.lit("new").alias("origin"))

    def work(table: keyed.KeyedTable) -> None:
        table.insert_ignore(every.filter("doc_id % 2 = 0").withColumn("origin", F.lit("old")), 1)
        table.insert_ignore(every, 2)

    return _written(v, every, ["doc_id"], work)


@query("C22_cascade_written", sql("SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE deleted_at IS NOT NULL)"))
def c22_written(v: Views) -> DataFrame:
    """Chunks of deleted documents go, and a late replay of the first batch does not bring them back."""
    rows = v.chunks().select("doc_id", "chunk_id")

    def work(table: keyed.KeyedTable) -> None:
        table.upsert(rows, 1)
        table.delete(v.docs().filter("deleted_at IS NOT NULL").select("doc_id"), 2)
        table.upsert(rows, 1)

    return _written(v, rows, ["doc_id", "chunk_id"], work)


@query("F18_update_written", sql(f"SELECT job_id, started_at, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 100 HOUR THEN 'failed' ELSE status END AS status FROM jobs"))
def f18_written(v: Views) -> DataFrame:
    """Stale jobs marked failed where they stand, twice: the second time none fits."""
    rows = v.jobs().select("job_id", "started_at", "status")

    def work(table: keyed.KeyedTable) -> None:
        table.upsert(rows, 1)
        stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=F.lit(100)))
        table.update(stale, {"status": F.lit("failed")}, 2)
        if table.update(stale, {"status": F.lit("failed")}, 3):
            raise AssertionError("an update that was repeated found rows")

    return _written(v, rows, ["job_id"], work)


@query("C22_cascade_delete", sql("SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE deleted_at IS NOT NULL)"))
def c22(v: Views) -> DataFrame:
    return v.chunks().join(v.docs().filter("deleted_at IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select("chunk_id")
