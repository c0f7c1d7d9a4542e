"""Usage, budgets, quotas, jobs and billing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the plans, fallback durations of the stages in ms.
PLANS = [("free", 50), ("starter", 300), ("pro", 2000)]
STAGE_FALLBACK_MS = {"extract": 120000, "chunk": 2000, "chunk_filter": 1000, "content_gate": 500, "tag_summarize": 5000, "load": 2000, "embed": 35000, "doc_embed": 1500, "dedup": 500}


def token_cost(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Adds cost: tokens times the model's price for a million, the default price for an unknown model, six places."""
    p = prices.select("model", F.col("price_in").alias("_in"), F.col("price_out").alias("_out"))
    cost = (F.col("tokens_in") * F.coalesce("_in", F.lit(default[0])) + F.col("tokens_out") * F.coalesce("_out", F.lit(default[1]))) / 1e6
    return usage.join(p, "model", "left").withColumn("cost", F.round(cost, 6)).drop("_in", "_out")


def budget_checks(usage: DataFrame, as_of: str, doc_cap: float, day_cap: float, sliding_cap: float) -> DataFrame:
    """(doc_id, doc_cost, day_cost, sliding_cost, blocked_by): used above the cap blocks; the
    first of document, day and last 24 hours wins."""
    now = F.lit(as_of).cast("timestamp")
    paid = usage.filter("success AND cost IS NOT NULL")
    whole = paid.agg(
        F.coalesce(F.sum(F.when((F.to_date("called_at") == F.to_date(now)), F.col("cost"))), F.lit(0.0)).alias("day_cost"),
        F.coalesce(F.sum(F.when((F.col("called_at") >= now - F.make_dt_interval(hours=F.lit(24))) & (F.col("called_at") <= now), F.col("cost"))), F.lit(0.0)).alias("sliding_cost"),
    )
    docs = paid.groupBy("doc_id").agg(F.sum("cost").alias("doc_cost"))
    verdict = F.when(F.col("doc_cost") > doc_cap, "doc").when(F.col("day_cost") > day_cap, "daily").when(F.col("sliding_cost") > sliding_cap, "sliding_24h")
    return docs.crossJoin(F.broadcast(whole)).withColumn("blocked_by", verdict)


def page_cap(called: Column, cap: Column) -> Column:
    """Blocked when as many pages were called as the cap allows; a cap of 0 or less is none."""
    return (cap > 0) & (called >= cap)


def mode_cap(mode: Column, default: int, overall: int) -> Column:
    """Pages by ingest mode: fast 10, default as given, precise unlimited; an unlimited overall cap wins."""
    if overall <= 0:
        return F.lit(0)
    return F.when(mode == "fast", 10).when(mode == "precise", 0).otherwise(default)


def budget_estimate(avg_cost: Column, avg_pages: Column, rows: Column, docs: Column) -> list[Column]:
    """The estimated budget of a document, and whether the sample is too small to trust."""
    return [(avg_cost * avg_pages * 0.5 * 1.5).alias("budget"), ((rows < 30) | (docs < 5)).alias("provisional")]


def rate_verdicts(events: DataFrame, user: str, at: str, key: str, abuse_cap: int, plans: DataFrame) -> DataFrame:
    """Each event's number on its UTC day, and 402 above the plan's limit, else 429 above the abuse cap, else 200."""
    w = Window.partitionBy(user, F.to_date(at)).orderBy(at, key)
    out = events.withColumn("n", F.row_number().over(w)).join(plans, "plan", "left")
    return out.withColumn("code", F.when(F.col("n") > F.col("plan_limit"), 402).when(F.col("n") > abuse_cap, 429).otherwise(200))


def user_key(user_id: Column, forwarded: Column) -> Column:
    """The user's id, or ip: and the first forwarded address."""
    return F.coalesce(user_id, F.concat(F.lit("ip:"), F.trim(F.get(F.split(forwarded, ","), F.lit(0)))))


def due(subscriptions: DataFrame, charged: DataFrame, as_of: str) -> DataFrame:
    """Active and overdue subscriptions whose period has ended and was not charged yet."""
    now = F.lit(as_of).cast("timestamp")
    return subscriptions.filter(F.col("status").isin("active", "past_due") & (F.col("period_end") <= now)).join(charged, ["user_id", "period_end"], "left_anti")


def sweep_past_due(subscriptions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Overdue for `days` or longer: canceled."""
    old = F.col("period_end") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return subscriptions.withColumn("status", F.when((F.col("status") == "past_due") & old, "canceled").otherwise(F.col("status")))


def next_month(at: Column) -> Column:
    """A month later, at most the month's last day."""
    return at + F.make_ym_interval(months=F.lit(1))


def fold_jobs(log: DataFrame) -> DataFrame:
    """(doc_id, status, queued_at, n): the latest state of each document and how many it had."""
    return log.groupBy("doc_id").agg(F.max_by("status", F.struct("queued_at", "job_id")).alias("status"), F.max("queued_at").alias("queued_at"), F.count("*").alias("n"))


def eta(jobs: DataFrame, medians: DataFrame, stages: list[str], page_ms: float | None = None) -> DataFrame:
    """Jobs (status, stage, current, total, unit) with eta_ms, what is left of their stage and of those after it.

    A stage takes its median, a fixed fallback where that is unknown.  Of the current stage the
    share that its progress leaves counts; pages still to extract count 1.2 times `page_ms` each
    instead.  Queued jobs and those without a known stage have all stages before them; ended jobs
    have none, and without any median there is no estimate.
    """
    spark = jobs.sparkSession
    table = spark.createDataFrame([(s, i, STAGE_FALLBACK_MS[s]) for i, s in enumerate(stages)], "stage string, at int, fallback int")
    known = table.join(medians, "stage", "left").select("at", "stage", F.coalesce("median_ms", F.col("fallback").cast("double")).alias("ms"), F.col("median_ms").isNotNull().alias("real"))
    # Nine rows become one: the durations in order.
    one = known.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stage", "ms"))), lambda x: x.stage).alias("_stages"), F.transform(F.array_sort(F.collect_list(F.struct("at", "stage", "ms"))), lambda x: x.ms).alias("_ms"), F.bool_or("real").alias("_any"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    at = F.when(F.col("status") == "queued", 0).otherwise(F.array_position("_stages", F.col("stage")))
    own = F.get("_ms", (at - 1).cast("int"))
    left = own * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("current") / F.col("total"))))
    pages = F.greatest(F.lit(0), F.col("total") - F.col("current")) * F.lit(page_ms).cast("double") * 1.2
    now = F.when((F.col("stage") == "extract") & (F.col("unit") == "pages") & (F.col("total") > 0) & pages.isNotNull(), pages).when(F.col("total") > 0, left).otherwise(own)
    later = total(F.slice("_ms", (at + 1).cast("int"), F.lit(len(stages))))
    value = F.when(F.coalesce(at, F.lit(0)) == 0, total(F.col("_ms"))).otherwise(F.floor(now) + later)
    out = jobs.crossJoin(F.broadcast(one)).withColumn("eta_ms", F.when(F.col("_any") & F.col("status").isin("queued", "running"), value))
    return out.drop("_stages", "_ms", "_any")


def source_type(value: Column, known: list[str], other: str) -> Column:
    """The value if it is known, else the other."""
    return F.when(value.isin(*known), value).otherwise(other)


def search_mode(mode: Column, known: list[str], default: str = "hybrid") -> Column:
    """A mode that is known, else the default."""
    return F.when(mode.isin(known), mode).otherwise(F.lit(default))


# Names of errors, the code and the words that tell a quota that is used up.
QUOTA_ERRORS = ["ResourceExhausted", "TooManyRequests"]


def is_quota_error(name: Column, code: Column, message: Column) -> Column:
    """Whether an error tells of a used-up quota: by its name, its code, or words in its message."""
    said = F.coalesce(message, F.lit(""))
    words = F.contains(F.upper(said), F.lit("RESOURCE_EXHAUSTED")) | F.contains(said, F.lit("429")) | F.contains(F.upper(said), F.lit("QUOTA"))
    return F.coalesce(name.isin(QUOTA_ERRORS), F.lit(False)) | F.coalesce(code == 429, F.lit(False)) | words
