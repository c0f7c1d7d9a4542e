"""Queries that run as streams over the event table, until all of it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.catalog import query
from lodestar.sources import shared
from lodestar.sources.views import Views, sql
from lodestar.streaming import logs, stages


class _Streamed(Views):
    """The same views over a stream of the table."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        rows = logs.source(self.spark, f"{self.dir}/{name}.parquet")
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(v: Views) -> Views:
    return _Streamed(v.spark, v.dir)


@query("B17_stream_trend", sql("SELECT floor(epoch(recorded_at) / 21600)::BIGINT * 21600 AS bucket_start, count(*) AS sample_count, round(avg(took_ms), 6) AS mean FROM search_log GROUP BY 1"))
def trend(v: Views) -> DataFrame:
    return logs.drain(logs.trend(_streamed(v).search_log(), "recorded_at", "took_ms"), "complete").withColumn("mean", F.round("mean", 6))


@query("W18_stream_sliding_cost", sql("SELECT start, round(sum(cost), 9) AS cost FROM (SELECT cost, floor(epoch(called_at) / 3600)::BIGINT * 3600 - h * 3600 AS start FROM usage, (SELECT unnest(range(0, 24)) AS h) WHERE success) GROUP BY start"))
def sliding(v: Views) -> DataFrame:
    return logs.drain(logs.sliding_cost(_streamed(v).usage()), "complete").withColumn("cost", F.round("cost", 9))


@query("B11_stream_job_states", sql("SELECT doc_id, arg_max(status, (queued_at, job_id)) AS status, count(*) AS n FROM jobs GROUP BY doc_id"))
def states(v: Views) -> DataFrame:
    return logs.drain(logs.job_states(_streamed(v).jobs()), "update", ["doc_id"]).select("doc_id", "status", "n")


@query("W_stream_sessions", sql("""SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""))
def sessions(v: Views) -> DataFrame:
    return logs.drain(logs.sessions(_streamed(v).table("events"), "user_id", "ts"), "complete")


_STAGES = """s AS (SELECT user_id % 500 AS job_id, ['extract','load','embed'][(user_id % 3 + 1)::INT] AS stage, event_id AS log_id, CASE WHEN event_type IN ('view', 'click') THEN 'started' WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, epoch_us(ts) // 1000 AS ms FROM events),
n AS (SELECT *, lead(status) OVER w AS next, lead(ms) OVER w - ms AS gap FROM s WINDOW w AS (PARTITION BY job_id, stage ORDER BY ms, log_id)),
p AS (SELECT job_id, stage, log_id, CASE WHEN coalesce(gap, 1e18) > 21600000 THEN 'failed' WHEN next = 'started' THEN 'restarted' ELSE next END AS status, least(gap, 21600000) AS duration_ms FROM n
  WHERE status = 'started' AND (gap IS NOT NULL OR ms + 21600000 <= (SELECT max(ms) - 3600000 FROM s)))"""


@query("B14_F17_B12_stages_with_timers", sql("SELECT job_id, stage, log_id, status, duration_ms::BIGINT AS duration_ms FROM p", _STAGES))
def stages_with_timers(v: Views) -> DataFrame:
    """Starts and ends of stages over several batches of the event table; what does not end in six hours has failed."""
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), "started").when(kind == "error", "failed").otherwise("succeeded")
    stage = F.get(F.array(*map(F.lit, ("extract", "load", "embed"))), (F.col("user_id") % 3).cast("int"))
    rows = v.table("events").select((F.col("user_id") % 500).alias("job_id"), stage.alias("stage"), F.col("event_id").alias("log_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
    folder = logs.in_turns(rows, "at", ["2024-01-08", "2024-01-16", "2024-01-24"], shared.folder(v.spark, "turns"))
    own = v.spark.newSession()  # the state store is a setting of the session that runs the stream
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set(stages.STORE, stages.ROCKS)
    done = logs.drain(stages.paired(logs.source(own, folder, 1), 6), "append")
    return v.spark.read.schema(done.schema).parquet(*{f.rsplit("/", 1)[0] for f in done.inputFiles()}) if done.inputFiles() else done
