"""Service levels, trends and daily counts over logs.  Every operator takes its now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import joins, percentiles

# The service-level buckets, the target in ms, the size of a large PDF, the trend ranges.
SLO_BUCKETS = ["pdf_50p", "image", "pdf_scan", "hwp", "url"]
SLO_TARGET_MS = 2000
LARGE_PDF_BYTES = 25 * 1024 * 1024
TRENDS = {"24h": (24, 3600), "7d": (7 * 24, 6 * 3600), "30d": (30 * 24, 24 * 3600)}
MODES = ["hybrid", "dense", "sparse"]
FALLBACKS = ["transient_5xx", "permanent_4xx", "none"]


def slo_bucket() -> Column:
    """The bucket of a document; null where none applies."""
    kind = F.col("doc_type")
    return (
        F.when((kind == "pdf") & F.col("scan"), "pdf_scan")
        .when((kind == "pdf") & (F.coalesce("size_bytes", F.lit(0)) >= LARGE_PDF_BYTES), "pdf_50p")
        .when(kind == "image", "image")
        .when(kind.isin("hwp", "hwpx"), "hwp")
        .when(kind == "url", "url")
    )


def slo(docs: DataFrame) -> DataFrame:
    """(bucket, sample_count, p95_ms, pass_rate) for every bucket, empty ones too."""
    rows = docs.filter(F.col("received_ms").isNotNull()).withColumn("bucket", slo_bucket()).filter("bucket IS NOT NULL")
    tail = percentiles.nearest(rows, ["bucket"], "received_ms", p95_ms=0.95)
    rate = rows.groupBy("bucket").agg(F.round(F.avg((F.col("received_ms") < SLO_TARGET_MS).cast("double")), 4).alias("pass_rate"))
    spine = docs.sparkSession.createDataFrame([(b,) for b in SLO_BUCKETS], "bucket string")
    return spine.join(tail, "bucket", "left").join(rate, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("sample_count"), "p95_ms", "pass_rate")


def slo_overall(buckets: DataFrame) -> DataFrame:
    """The pass rate weighted by samples, and the buckets that have any."""
    some = buckets.filter("sample_count > 0")
    return some.agg(
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total_samples"),
        F.round(F.sum(F.col("pass_rate") * F.col("sample_count")) / F.sum("sample_count"), 4).alias("overall_pass_rate"),
        F.array_join(F.array_sort(F.collect_list("bucket")), ",").alias("buckets_with_samples"),
    )


def recent(log: DataFrame, at: str, key: str, n: int = 500) -> DataFrame:
    """The ring buffer: the latest n rows."""
    return log.orderBy(F.desc(at), F.desc(key)).limit(n)


def by_mode(log: DataFrame) -> DataFrame:
    """Counts, percentiles by rank, averages, rates and fallbacks by reason, overall and for each mode; a mode without rows stays, with zeros."""
    rows = log.withColumn("mode", F.explode(F.array("mode", F.lit("overall"))))
    reason = F.coalesce("fallback_reason", F.lit("none"))
    agg = [
        F.count("*").alias("n"),
        F.round(F.avg("took_ms"), 2).alias("avg_ms"),
        F.round(F.avg("fused"), 2).alias("avg_fused"),
        F.round(F.avg(F.col("cache_hit").cast("double")), 4).alias("cache_hit_rate"),
        F.count("fallback_reason").alias("fallbacks"),
        *[F.count_if(reason == k).alias(k) for k in FALLBACKS],
    ]
    sums = rows.groupBy("mode").agg(*agg)
    tails = percentiles.nearest(rows, ["mode"], "took_ms", p50_ms=0.5, p95_ms=0.95).drop("n")
    spine = log.sparkSession.createDataFrame([(m,) for m in [*MODES, "overall"]], "mode string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(sums, "mode", "left").join(tails, "mode", "left").select("mode", zero("n"), "p50_ms", "p95_ms", *map(zero, FALLBACKS), "avg_ms", "avg_fused", "cache_hit_rate", zero("fallbacks"))


def trend(log: DataFrame, at: str, value: str, flag: Column, as_of: str, span: str) -> DataFrame:
    """(bucket_start, sample_count, p50_ms, p95_ms, flagged): epoch-aligned buckets of one range, both ends included, zeros where empty."""
    hours, seconds = TRENDS[span]
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(hours=F.lit(hours))
    bucket = (F.floor(F.unix_timestamp(at) / seconds) * seconds).cast("bigint")
    first = F.timestamp_seconds(F.floor(F.unix_timestamp(start) / seconds) * seconds)
    rows = log.filter((F.col(at) >= first) & (F.col(at) <= end)).withColumn("bucket_start", bucket)
    counts = rows.groupBy("bucket_start").agg(F.count("*").alias("sample_count"), F.count_if(flag).alias("flagged"))
    counts = counts.join(percentiles.interpolated_int(rows, ["bucket_start"], value, p50_ms=0.5, p95_ms=0.95).drop("n"), "bucket_start", "left")
    spark: SparkSession = log.sparkSession
    begin = spark.range(1).select(start.cast("string").alias("x")).first()["x"]
    return joins.zero_fill(joins.buckets(spark, begin, as_of, seconds), counts, "bucket_start", ["sample_count", "p50_ms", "p95_ms", "flagged"])


def kst_day(at: str) -> Column:
    """The day in Korea of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(F.col(at), "Asia/Seoul"))


def is_success() -> Column:
    """A search that fell back on nothing and found something."""
    return F.col("fallback_reason").isNull() & F.coalesce(F.col("fused") > 0, F.lit(False))


def failure() -> Column:
    """Why a search failed; null for a success and where the hit count is unknown."""
    return F.when(F.col("fallback_reason").isin("permanent_4xx", "transient_5xx"), F.col("fallback_reason")).when(F.col("fused") == 0, "no_hits")


def stage_medians(logs: DataFrame, last: int = 500, least: int = 3) -> DataFrame:
    """(stage, n, median_ms) of the latest succeeded logs with a duration, where there are enough."""
    some = logs.filter((F.col("status") == "succeeded") & (F.col("duration_ms") > 0)).orderBy(F.desc("log_id")).limit(last)
    return some.groupBy("stage").agg(F.count("*").alias("n"), F.median("duration_ms").alias("median_ms")).filter(F.col("n") >= least)


def stage_durations(log: DataFrame) -> DataFrame:
    """(log_id, job_id, stage, status, duration_ms) of rows (log_id, job_id, stage, status, at): from the start of a run to its end; open ones are running.

    The start and the end of a run share its log id: a job can run a stage again, also before the first run has ended."""
    started, ended = F.col("status") == "started", F.col("status") != "started"
    pairs = log.groupBy("log_id", "job_id", "stage").agg(F.min(F.when(started, F.col("at"))).alias("a"), F.max_by(F.when(ended, F.col("status")), F.when(ended, F.col("at"))).alias("s"), F.max(F.when(ended, F.col("at"))).alias("b"))
    return pairs.select("log_id", "job_id", "stage", F.coalesce("s", F.lit("running")).alias("status"), (F.col("b") - F.col("a")).alias("duration_ms"))


def budget_sample(usage: DataFrame) -> DataFrame:
    """One row of ten measures over (success, cost, doc_id, page): costs of successful calls, and distinct pages of documents that have any."""
    ok, cost = F.col("success"), F.when(F.col("success"), F.col("cost"))
    pages = usage.filter(ok & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count_distinct("page").cast("double").alias("p")).filter("p > 0")
    pages = pages.agg(F.round(F.avg("p"), 6).alias("avg_pages"), F.round(F.median("p"), 6).alias("median_pages"))
    calls = usage.agg(
        F.count(cost).alias("sample_rows"),
        F.count_if(ok).alias("success_rows"),
        F.count_if(~ok).alias("failed_rows"),
        F.count_distinct(F.when(ok, F.col("doc_id"))).alias("unique_docs"),
        F.count_if(ok & F.col("doc_id").isNull()).alias("null_doc_rows"),
        F.round(F.avg(cost), 8).alias("avg_cost"),
        F.round(F.median(cost), 8).alias("median_cost"),
        F.round(F.max(cost), 8).alias("max_cost"),
    )
    return calls.crossJoin(pages)  # one row each
