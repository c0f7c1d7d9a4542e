"""Queries of usage, budgets, quotas, jobs and billing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import metering, telemetry
from lodestar.plans.catalog import query
from lodestar.sources.views import AS_OF, STAGES, Views, sql


@query("A44_daily_counters", sql("SELECT user_key, event_type, called_at::DATE::VARCHAR AS day, count(*) AS n FROM usage GROUP BY 1, 2, 3"))
def a44(v: Views) -> DataFrame:
    return v.usage().groupBy("user_key", "event_type", F.to_date("called_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("B1_budget_checks", sql(f"""SELECT doc_id, round(doc_cost, 8) AS doc_cost, CASE WHEN doc_cost > 0.03 THEN 'doc' WHEN day > 0.5 THEN 'daily' WHEN sliding > 0.1 THEN 'sliding_24h' END AS blocked_by
  FROM (SELECT doc_id, sum(cost) AS doc_cost FROM usage WHERE success GROUP BY doc_id),
  (SELECT coalesce(sum(cost) FILTER (called_at::DATE = DATE '2024-01-30'), 0) AS day, coalesce(sum(cost) FILTER (called_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AND called_at <= TIMESTAMP '2024-01-30 12:00:00'), 0) AS sliding FROM usage WHERE success)"""))
def b1(v: Views) -> DataFrame:
    return metering.budget_checks(v.usage(), "2024-01-30 12:00:00", 0.03, 0.5, 0.1).select("doc_id", F.round("doc_cost", 8).alias("doc_cost"), "blocked_by")


@query("B2_B3_page_caps", sql("SELECT doc_id, mode, pages >= cap AND cap > 0 AS blocked FROM (SELECT doc_id, ['fast', 'default', 'precise'][(doc_id % 3 + 1)::INT] AS mode, CASE doc_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 50 ELSE 0 END AS cap, count(DISTINCT page) AS pages FROM usage GROUP BY doc_id)"))
def b2(v: Views) -> DataFrame:
    mode = F.get(F.array(F.lit("fast"), F.lit("default"), F.lit("precise")), (F.col("doc_id") % 3).cast("int"))
    pages = v.usage().groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).withColumn("mode", mode)
    return pages.select("doc_id", "mode", metering.page_cap(F.col("pages"), metering.mode_cap(F.col("mode"), 50, 50)).alias("blocked"))


@query("B4_budget_estimate", sql("SELECT round(avg_cost * avg_pages * 0.75, 8) AS budget, n < 30 OR docs < 5 AS provisional FROM (SELECT avg(cost) AS avg_cost, count(*) AS n, count(DISTINCT doc_id) AS docs FROM usage WHERE success), (SELECT avg(p) AS avg_pages FROM (SELECT count(DISTINCT page)::DOUBLE AS p FROM usage WHERE success GROUP BY doc_id))"))
def b4(v: Views) -> DataFrame:
    ok = v.usage().filter("success")
    pages = ok.groupBy("doc_id").agg(F.count_distinct("page").cast("double").alias("p")).agg(F.avg("p").alias("avg_pages"))
    sample = ok.agg(F.avg("cost").alias("avg_cost"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).crossJoin(pages)
    out = sample.select(*metering.budget_estimate(F.col("avg_cost"), F.col("avg_pages"), F.col("n"), F.col("docs")))
    return out.withColumn("budget", F.round("budget", 8))


@query("B5_N25_token_cost", sql("SELECT event_id, round((page * 100 * coalesce(pi, 0.3) + page * 10 * coalesce(po, 2.5)) / 1e6, 6) AS cost FROM usage LEFT JOIN (SELECT unnest(['view', 'click']) AS m, unnest([0.1, 0.2]::DOUBLE[]) AS pi, unnest([0.4, 0.8]::DOUBLE[]) AS po) ON m = event_type"))
def b5(v: Views) -> DataFrame:
    use = v.usage().select("event_id", F.col("event_type").alias("model"), (F.col("page") * 100).alias("tokens_in"), (F.col("page") * 10).alias("tokens_out"))
    prices = v.spark.createDataFrame([("view", 0.1, 0.4), ("click", 0.2, 0.8)], "model string, price_in double, price_out double")
    return metering.token_cost(use, prices, (0.3, 2.5)).select("event_id", "cost")


@query("B6_rate_limit", sql("SELECT event_id, n, CASE WHEN n > lim THEN 402 WHEN n > 4 THEN 429 ELSE 200 END AS code FROM (SELECT event_id, row_number() OVER (PARTITION BY user_key, called_at::DATE ORDER BY called_at, event_id) AS n, [2, 3, 6][(user_key % 3 + 1)::INT] AS lim FROM usage)"))
def b6(v: Views) -> DataFrame:
    plans = v.spark.createDataFrame([("free", 2), ("starter", 3), ("pro", 6)], "plan string, plan_limit int")
    use = v.usage().withColumn("plan", F.get(F.array(F.lit("free"), F.lit("starter"), F.lit("pro")), (F.col("user_key") % 3).cast("int")))
    return metering.rate_verdicts(use, "user_key", "called_at", "event_id", 4, plans).select("event_id", "n", "code")


@query("B7_user_key", sql("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'ip:10.0.0.' || user_id ELSE user_id::VARCHAR END AS key FROM events"))
def b7(v: Views) -> DataFrame:
    user = F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string"))
    forwarded = F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 192.168.0.1"))
    return v.table("events").select("event_id", metering.user_key(user, forwarded).alias("key"))


@query("B8_charges_due", sql("SELECT user_id FROM subscriptions WHERE status IN ('active', 'past_due') AND period_end <= TIMESTAMP '2024-01-31' AND user_id % 5 <> 0"))
def b8(v: Views) -> DataFrame:
    s = v.subscriptions()
    return metering.due(s, s.filter("user_id % 5 = 0").select("user_id", "period_end"), AS_OF).select("user_id")


@query("B9_past_due_sweep", sql("SELECT user_id, CASE WHEN status = 'past_due' AND period_end <= TIMESTAMP '2024-01-24' THEN 'canceled' ELSE status END AS status FROM subscriptions"))
def b9(v: Views) -> DataFrame:
    return metering.sweep_past_due(v.subscriptions(), AS_OF).select("user_id", "status")


@query("B10_next_month", sql("SELECT user_id, strftime(period_end + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_end FROM subscriptions"))
def b10(v: Views) -> DataFrame:
    return v.subscriptions().select("user_id", F.date_format(metering.next_month(F.col("period_end")), "yyyy-MM-dd").alias("next_end"))


@query("B11_job_states", sql("SELECT doc_id, arg_max(status, (queued_at, job_id)) AS status, count(*) AS n FROM jobs GROUP BY doc_id"))
def b11(v: Views) -> DataFrame:
    return metering.fold_jobs(v.jobs()).select("doc_id", "status", "n")


_FALLBACK = "(SELECT unnest(['extract','chunk','chunk_filter','content_gate','tag_summarize','load','embed','doc_embed','dedup']) AS stage, unnest(range(0, 9)) AS at, unnest([120000, 2000, 1000, 500, 5000, 2000, 35000, 1500, 500]) AS fb)"


@query("B13_eta", sql(f"""SELECT log_id, CASE WHEN status IN ('queued', 'running') THEN CASE WHEN status = 'queued' OR pos IS NULL THEN (SELECT sum(ms) FROM st) ELSE floor(CASE WHEN stage = 'extract' AND total > 0 THEN (total - cur) * 2500.0::DOUBLE * 1.2 WHEN total > 0 THEN ms * (1 - greatest(0, least(1, cur / total::DOUBLE))) ELSE ms END) + coalesce((SELECT sum(x.ms) FROM st x WHERE x.pos > j.pos), 0) END END AS eta_ms
  FROM (SELECT l.*, st.pos, st.ms FROM (SELECT log_id, stage, ['queued', 'running', 'completed'][(log_id % 3 + 1)::INT] AS status, CASE WHEN log_id % 4 > 0 THEN log_id % 7 END AS cur, CASE WHEN log_id % 4 > 0 THEN (log_id % 4) * 3 - 3 END AS total FROM (SELECT log_id, CASE WHEN log_id % 11 > 0 THEN stage END AS stage FROM stage_logs)) l LEFT JOIN st ON st.stage = l.stage) j""",
  f"""st AS (SELECT s.stage, s.at AS pos, coalesce(m.median_ms, s.fb)::DOUBLE AS ms FROM {_FALLBACK} s LEFT JOIN (
    SELECT stage, median(duration_ms) AS median_ms FROM (SELECT * FROM stage_logs WHERE status = 'succeeded' AND duration_ms > 0 ORDER BY log_id DESC LIMIT 500) GROUP BY stage HAVING count(*) >= 3) m USING (stage))"""))
def b13(v: Views) -> DataFrame:
    """Every stage log as a job: queued, running with and without progress and stage, and ended."""
    i, logs = F.col("log_id"), v.stage_logs()
    status = F.get(F.array(F.lit("queued"), F.lit("running"), F.lit("completed")), (i % 3).cast("int"))
    jobs = logs.select("log_id", F.when(i % 11 > 0, F.col("stage")).alias("stage"), status.alias("status"), F.when(i % 4 > 0, i % 7).alias("current"), F.when(i % 4 > 0, i % 4 * 3 - 3).alias("total"), F.lit("pages").alias("unit"))
    return metering.eta(jobs, telemetry.stage_medians(logs), STAGES, 2500.0).select("log_id", "eta_ms")


@query("B13_eta_without_baseline", sql("SELECT log_id, NULL::DOUBLE AS eta_ms FROM stage_logs WHERE status = 'skipped'"))
def b13b(v: Views) -> DataFrame:
    logs = v.stage_logs()
    jobs = logs.filter("status = 'skipped'").select("log_id", "stage", F.lit("running").alias("status"), F.lit(None).cast("bigint").alias("current"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("string").alias("unit"))
    return metering.eta(jobs, telemetry.stage_medians(logs.filter("false")), STAGES).select("log_id", "eta_ms")


@query("B15_B16_coercions", sql("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS source_type, left(props, 5) AS error FROM events"))
def b15(v: Views) -> DataFrame:
    return v.table("events").select("event_id", metering.source_type(F.col("event_type"), ["view", "click"], "unknown").alias("source_type"), F.left("props", F.lit(5)).alias("error"))


@query("Q15_quota_errors", sql("SELECT event_id, contains(upper(event_type), 'ERR') OR fused_code = 42 AS is_quota FROM (SELECT event_id, event_type, (props->>'$.k')::INT AS fused_code FROM events)"))
def q15(v: Views) -> DataFrame:
    return v.table("events").select("event_id", (F.contains(F.upper("event_type"), F.lit("ERR")) | (F.get_json_object("props", "$.k").cast("int") == 42)).alias("is_quota"))
