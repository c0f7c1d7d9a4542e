"""Queries of service levels, trends, daily counts and percentiles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import joins, percentiles, telemetry
from lodestar.plans.catalog import query
from lodestar.sources.views import AS_OF, Views, sql

_SLO = """b AS (SELECT received_ms, CASE WHEN doc_type = 'pdf' AND scan THEN 'pdf_scan' WHEN doc_type = 'pdf' AND size_bytes >= 26214400 THEN 'pdf_50p' WHEN doc_type = 'image' THEN 'image' WHEN doc_type IN ('hwp', 'hwpx') THEN 'hwp' WHEN doc_type = 'url' THEN 'url' END AS bucket FROM docs WHERE received_ms IS NOT NULL),
slo AS (SELECT bucket, coalesce(n, 0) AS sample_count, p95_ms, pass_rate FROM (SELECT unnest(['pdf_50p', 'image', 'pdf_scan', 'hwp', 'url']) AS bucket) LEFT JOIN (
  SELECT bucket, count(*) AS n, list_sort(list(received_ms))[(floor(0.95 * (count(*) - 1)) + 1)::INT] AS p95_ms, round(avg(CASE WHEN received_ms < 2000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS pass_rate FROM b GROUP BY bucket) USING (bucket))"""


@query("A11_slo_buckets", sql("SELECT * FROM slo", _SLO))
def a11(v: Views) -> DataFrame:
    return telemetry.slo(v.docs())


@query("A12_weighted_slo", sql("SELECT sum(sample_count)::BIGINT AS total_samples, round(sum(pass_rate * sample_count) / sum(sample_count), 4) AS overall_pass_rate, array_to_string(list_sort(list(bucket)), ',') AS buckets_with_samples FROM slo WHERE sample_count > 0", _SLO))
def a12(v: Views) -> DataFrame:
    return telemetry.slo_overall(telemetry.slo(v.docs()))


@query("A13_nearest_rank", sql("SELECT mode, count(*) AS n, list_sort(list(took_ms))[(floor(0.5 * (count(*) - 1)) + 1)::INT] AS p50, list_sort(list(took_ms))[(floor(0.95 * (count(*) - 1)) + 1)::INT] AS p95 FROM search_log GROUP BY mode"))
def a13(v: Views) -> DataFrame:
    return percentiles.nearest(v.search_log(), ["mode"], "took_ms", p50=0.5, p95=0.95)


@query("A14_rounded_rank", sql("SELECT mode, count(*) AS n, list_sort(list(took_ms))[(round_even(0.9 * (count(*) - 1), 0) + 1)::INT] AS p90 FROM search_log GROUP BY mode"))
def a14(v: Views) -> DataFrame:
    return percentiles.rounded(v.search_log(), ["mode"], "took_ms", p90=0.9)


@query("A15_linear", sql("SELECT mode, round(quantile_cont(took_ms, 0.95), 6) AS p95 FROM search_log GROUP BY mode"))
def a15(v: Views) -> DataFrame:
    return percentiles.interpolated(v.search_log(), ["mode"], "took_ms", p95=0.95).select("mode", F.round("p95", 6).alias("p95"))


@query("A16_continuous_int", sql("SELECT mode, coalesce(round_even(quantile_cont(took_ms, 0.5), 0), 0)::INT AS p50, coalesce(round_even(quantile_cont(took_ms, 0.95), 0), 0)::INT AS p95 FROM search_log GROUP BY mode"))
def a16(v: Views) -> DataFrame:
    found = percentiles.interpolated_int(v.search_log(), ["mode"], "took_ms", p50=0.5, p95=0.95)
    return v.search_log().select("mode").distinct().join(found, "mode", "left").select("mode", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p50", "p95")])


@query("A17_stage_medians", sql("SELECT stage, count(*) AS n, median(duration_ms) AS median_ms FROM (SELECT * FROM stage_logs WHERE status = 'succeeded' AND duration_ms > 0 ORDER BY log_id DESC LIMIT 500) GROUP BY stage HAVING count(*) >= 3"))
def a17(v: Views) -> DataFrame:
    return telemetry.stage_medians(v.stage_logs())


@query("A18_filtered_counts", sql("SELECT count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad, count(page) AS paged FROM usage"))
def a18(v: Views) -> DataFrame:
    return v.usage().agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad"), F.count("page").alias("paged"))


_MODE_AGG = "count(*) AS n, list_sort(list(took_ms))[(floor(0.5 * (count(*) - 1)) + 1)::INT] AS p50_ms, list_sort(list(took_ms))[(floor(0.95 * (count(*) - 1)) + 1)::INT] AS p95_ms, count(*) FILTER (fallback_reason = 'transient_5xx') AS transient_5xx, count(*) FILTER (fallback_reason = 'permanent_4xx') AS permanent_4xx, count(*) FILTER (fallback_reason IS NULL) AS none, round(avg(took_ms), 2) AS avg_ms, round(avg(fused), 2) AS avg_fused, round(avg(CASE WHEN cache_hit THEN 1.0::DOUBLE ELSE 0 END), 4) AS cache_hit_rate, count(fallback_reason) AS fallbacks"
_MODES = "SELECT mode, coalesce(n, 0) AS n, p50_ms, p95_ms, coalesce(transient_5xx, 0) AS transient_5xx, coalesce(permanent_4xx, 0) AS permanent_4xx, coalesce(none, 0) AS none, avg_ms, avg_fused, cache_hit_rate, coalesce(fallbacks, 0) AS fallbacks FROM (SELECT unnest(['hybrid', 'dense', 'sparse', 'overall']) AS mode) LEFT JOIN (SELECT coalesce(mode, 'overall') AS mode, {agg} FROM {log} GROUP BY GROUPING SETS ((mode), ())) USING (mode)"


@query("A19_ring_buffer", sql(_MODES.format(agg=_MODE_AGG, log="(SELECT * FROM search_log ORDER BY recorded_at DESC, event_id DESC LIMIT 500)")))
def a19(v: Views) -> DataFrame:
    return telemetry.by_mode(telemetry.recent(v.search_log(), "recorded_at", "event_id"))


@query("A20_by_mode", sql(_MODES.format(agg=_MODE_AGG, log="search_log")))
def a20(v: Views) -> DataFrame:
    return telemetry.by_mode(v.search_log())


_DAYS = "(SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day)"


@query("A21_X18_daily_kst", sql(f"SELECT day::VARCHAR AS day, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(n - ok, 0) AS bad FROM {_DAYS} LEFT JOIN (SELECT (recorded_at + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n, count(*) FILTER (fallback_reason IS NULL AND fused > 0) AS ok FROM search_log GROUP BY 1) USING (day)"))
def a21(v: Views) -> DataFrame:
    rows = v.search_log().groupBy(telemetry.kst_day("recorded_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(telemetry.is_success()).alias("ok"))
    rows = rows.withColumn("bad", F.col("n") - F.col("ok"))
    return joins.zero_fill(joins.days(v.spark, "2024-01-01", "2024-02-02"), rows, "day", ["n", "ok", "bad"]).withColumn("day", F.col("day").cast("string"))


@query("A22_daily_feedback", sql(f"SELECT day::VARCHAR AS day, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM {_DAYS} LEFT JOIN (SELECT (created_at + INTERVAL 9 HOUR)::DATE AS day, count(*) FILTER (helpful) AS up, count(*) FILTER (NOT helpful) AS down FROM feedback GROUP BY 1) USING (day)"))
def a22(v: Views) -> DataFrame:
    rows = v.feedback().groupBy(telemetry.kst_day("created_at").alias("day")).agg(F.count_if("helpful").alias("up"), F.count_if(~F.col("helpful")).alias("down"))
    return joins.zero_fill(joins.days(v.spark, "2024-01-01", "2024-02-02"), rows, "day", ["up", "down"]).withColumn("day", F.col("day").cast("string"))


@query("A25_success_rate", sql("SELECT round(avg(CASE WHEN fallback_reason IS NULL AND fused > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS success_rate, trunc(avg(took_ms))::INT AS avg_ms FROM search_log"))
def a25(v: Views) -> DataFrame:
    return v.search_log().agg(F.round(F.avg(telemetry.is_success().cast("double")), 4).alias("success_rate"), F.avg("took_ms").cast("int").alias("avg_ms"))


_USED = "used AS (SELECT *, success AND event_id % 10 > 0 AS paid FROM usage)"


@query("A26_costs", sql(f"""SELECT round(sum(cost) FILTER (paid), 9) AS total, round(coalesce(sum(cost) FILTER (paid AND called_at::DATE = DATE '2024-01-30'), 0), 9) AS day, round(coalesce(sum(cost) FILTER (paid AND called_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR), 0), 9) AS last_24h,
  round(coalesce(sum(cost) FILTER (paid AND called_at >= TIMESTAMP '2024-01-01'), 0), 9) AS month, count(*) FILTER (success AND called_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS calls_30d FROM used""", _USED))
def a26(v: Views) -> DataFrame:
    """Costs come as text; one in ten is no number and is left out of the sums."""
    now, cost = F.lit(AS_OF).cast("timestamp"), F.when(F.col("event_id") % 10 > 0, F.col("cost").cast("string")).otherwise("n/a")
    rows = v.usage().withColumn("cost", cost.try_cast("double"))
    paid = lambda *c: F.round(F.coalesce(F.sum(F.when(reduce(and_, c, F.col("success")), F.col("cost"))), F.lit(0.0)), 9)
    since = lambda **x: F.col("called_at") >= now - F.make_dt_interval(**{k: F.lit(n) for k, n in x.items()})
    return rows.agg(
        paid().alias("total"),
        paid(F.to_date("called_at") == F.lit("2024-01-30").cast("date")).alias("day"),
        paid(since(hours=24)).alias("last_24h"),
        paid(F.col("called_at") >= F.date_trunc("month", now)).alias("month"),
        F.count_if(F.col("success") & since(days=30)).alias("calls_30d"),
    )


@query("A26_cost_by_document", sql("SELECT doc_id, round(sum(cost), 9) AS cost FROM used WHERE paid GROUP BY doc_id", _USED))
def a26b(v: Views) -> DataFrame:
    return v.usage().filter("success AND event_id % 10 > 0").groupBy("doc_id").agg(F.round(F.sum("cost"), 9).alias("cost"))


@query("A27_budget_sample", sql("""SELECT count(c) FILTER (success) AS sample_rows, count(*) FILTER (success) AS success_rows, count(*) FILTER (NOT success) AS failed_rows, count(DISTINCT d) FILTER (success) AS unique_docs, count(*) FILTER (success AND d IS NULL) AS null_doc_rows,
  round(avg(c) FILTER (success), 8) AS avg_cost, round(median(c) FILTER (success), 8) AS median_cost, round(max(c) FILTER (success), 8) AS max_cost,
  (SELECT round(avg(p), 6) FROM pages) AS avg_pages, (SELECT round(median(p), 6) FROM pages) AS median_pages FROM used""",
  "used AS (SELECT success, CASE WHEN event_id % 10 > 0 THEN cost END AS c, CASE WHEN event_id % 7 > 0 THEN doc_id END AS d, CASE WHEN event_id % 3 > 0 THEN page END AS page FROM usage)", "pages AS (SELECT count(DISTINCT page)::DOUBLE AS p FROM used WHERE success AND d IS NOT NULL GROUP BY d HAVING count(DISTINCT page) > 0)"))
def a27(v: Views) -> DataFrame:
    i = F.col("event_id")
    used = v.usage().select("success", F.when(i % 10 > 0, F.col("cost")).alias("cost"), F.when(i % 7 > 0, F.col("doc_id")).alias("doc_id"), F.when(i % 3 > 0, F.col("page")).alias("page"))
    return telemetry.budget_sample(used)


@query("A36_rollup_by_doc", sql("SELECT user_key, round(avg(CASE WHEN success THEN 0.0::DOUBLE ELSE 1 END), 6) AS skip_rate, count(*) AS n FROM usage GROUP BY ROLLUP (user_key)"))
def a36(v: Views) -> DataFrame:
    return v.usage().rollup("user_key").agg(F.round(F.avg((~F.col("success")).cast("double")), 6).alias("skip_rate"), F.count("*").alias("n"))


@query("A39_threshold_grid", sql("SELECT t, count(*) FILTER (took_ms > t) AS over FROM search_log, (SELECT unnest([10, 50, 100, 200]) AS t) GROUP BY t"))
def a39(v: Views) -> DataFrame:
    over = v.search_log().agg(*[F.count_if(F.col("took_ms") > t).alias(str(t)) for t in (10, 50, 100, 200)])  # one pass, no cross join
    return over.unpivot([], ["10", "50", "100", "200"], "t", "over").select(F.col("t").cast("int").alias("t"), "over")


@query("A40_histogram", sql("SELECT least(floor(took_ms / 50), 9)::INT AS bin, count(*) AS n FROM search_log GROUP BY 1"))
def a40(v: Views) -> DataFrame:
    return v.search_log().groupBy(F.least(F.floor(F.col("took_ms") / 50), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("A41_J19_job_durations", sql("SELECT d.doc_id, coalesce(ms, 0) AS ms, coalesce(pages, 1) AS pages FROM docs d LEFT JOIN (SELECT job_id, sum(duration_ms)::BIGINT AS ms FROM stage_logs WHERE status IN ('succeeded', 'skipped') GROUP BY 1) l ON l.job_id = d.doc_id LEFT JOIN (SELECT doc_id, max(page) AS pages FROM chunks GROUP BY 1) p ON p.doc_id = d.doc_id"))
def a41(v: Views) -> DataFrame:
    ms = v.stage_logs().filter(F.col("status").isin("succeeded", "skipped")).groupBy(F.col("job_id").alias("doc_id")).agg(F.sum("duration_ms").alias("ms"))
    pages = v.chunks().groupBy("doc_id").agg(F.max("page").alias("pages"))
    return v.docs().join(ms, "doc_id", "left").join(pages, "doc_id", "left").select("doc_id", F.coalesce("ms", F.lit(0)).alias("ms"), F.coalesce("pages", F.lit(1)).alias("pages"))


@query("A43_duration_slo", sql("""SELECT doc_type, count(*) AS n, count(*) FILTER (ms > 0 AND ms <= slo) AS met FROM (SELECT doc_type, ms, CASE WHEN doc_type = 'pdf' AND pages <= 20 THEN 60000 WHEN doc_type = 'pdf' THEN 180000 WHEN doc_type IN ('hwp', 'hwpx') THEN 90000 WHEN doc_type = 'image' THEN 15000 WHEN doc_type = 'url' THEN 30000 ELSE 60000 END AS slo
  FROM docs d LEFT JOIN (SELECT job_id, sum(duration_ms) AS ms FROM stage_logs GROUP BY 1) l ON l.job_id = d.doc_id LEFT JOIN (SELECT doc_id, max(page) AS pages FROM chunks GROUP BY 1) p ON p.doc_id = d.doc_id) GROUP BY doc_type"""))
def a43(v: Views) -> DataFrame:
    kind = F.col("doc_type")
    # Limits in ms by type; PDFs up to 20 pages count as text.
    limit = F.when((kind == "pdf") & (F.col("pages") <= 20), 60000).when(kind == "pdf", 180000).when(kind.isin("hwp", "hwpx"), 90000).when(kind == "image", 15000).when(kind == "url", 30000).otherwise(60000)
    ms = v.stage_logs().groupBy(F.col("job_id").alias("doc_id")).agg(F.sum("duration_ms").alias("ms"))
    pages = v.chunks().groupBy("doc_id").agg(F.max("page").alias("pages"))
    rows = v.docs().join(ms, "doc_id", "left").join(pages, "doc_id", "left")
    return rows.groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if((F.col("ms") > 0) & (F.col("ms") <= limit)).alias("met"))


@query("A46_null_vectors", sql("SELECT d.user_id, count(*) AS n, count(*) FILTER (v.vec IS NULL) AS missing FROM docs d LEFT JOIN vecs v USING (doc_id) GROUP BY d.user_id"))
def a46(v: Views) -> DataFrame:
    return v.docs().join(v.vecs(), "doc_id", "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("vec").isNull()).alias("missing"))


def _trend_sql(hours: int, seconds: int) -> str:
    end = f"epoch(TIMESTAMP '{AS_OF}')::BIGINT"
    first = f"(({end} - {hours * 3600}) // {seconds} * {seconds})"
    return sql(f"""SELECT bucket_start, coalesce(n, 0) AS sample_count, coalesce(p50, 0) AS p50_ms, coalesce(p95, 0) AS p95_ms, coalesce(f, 0) AS flagged FROM (SELECT unnest(generate_series({first}, {end}, {seconds}))::BIGINT AS bucket_start)
  LEFT JOIN (SELECT floor(epoch(recorded_at) / {seconds})::BIGINT * {seconds} AS bucket_start, count(*) AS n, round_even(quantile_cont(took_ms, 0.5), 0)::INT AS p50, round_even(quantile_cont(took_ms, 0.95), 0)::INT AS p95, count(*) FILTER (fallback_reason IS NOT NULL) AS f
  FROM search_log WHERE epoch(recorded_at) >= {first} AND recorded_at <= TIMESTAMP '{AS_OF}' GROUP BY 1) USING (bucket_start)""")


@query("B17_trend_24h", _trend_sql(*telemetry.TRENDS["24h"]))
def b17_day(v: Views) -> DataFrame:
    return telemetry.trend(v.search_log(), "recorded_at", "took_ms", F.col("fallback_reason").isNotNull(), AS_OF, "24h")


@query("B17_trend_7d", _trend_sql(*telemetry.TRENDS["7d"]))
def b17_week(v: Views) -> DataFrame:
    return telemetry.trend(v.search_log(), "recorded_at", "took_ms", F.col("fallback_reason").isNotNull(), AS_OF, "7d")


@query("B17_trend_30d", _trend_sql(*telemetry.TRENDS["30d"]))
def b17_month(v: Views) -> DataFrame:
    return telemetry.trend(v.search_log(), "recorded_at", "took_ms", F.col("fallback_reason").isNotNull(), AS_OF, "30d")


@query("Q11_failure_reasons", sql("SELECT coalesce(CASE WHEN fallback_reason IN ('permanent_4xx', 'transient_5xx') THEN fallback_reason WHEN fused = 0 THEN 'no_hits' END, 'success') AS reason, count(*) AS n FROM search_log GROUP BY 1"))
def q11(v: Views) -> DataFrame:
    return v.search_log().groupBy(F.coalesce(telemetry.failure(), F.lit("success")).alias("reason")).agg(F.count("*").alias("n"))
