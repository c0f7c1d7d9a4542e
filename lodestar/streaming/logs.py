"""Streaming forms of the time-bucketed reports, of job states and of sliding costs.

Each takes and returns streaming DataFrames; `drain` runs one over what is there and
keeps the latest result as Parquet in a shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import folder as shared_folder


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files, `files` of them in a batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{path}*").schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{path}*")  # a stream takes folders or patterns


def in_turns(rows: DataFrame, at: str, bounds: list[str], folder: str) -> str:
    """`rows` as a folder of files that a stream reads one after the other: those before each bound, then the rest."""
    instant = lambda x: F.lit(x).cast("timestamp")
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        part = rows if low is None else rows.filter(F.col(at) >= instant(low))
        part = part if high is None else part.filter(F.col(at) < instant(high))
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    return f"{folder}/"


def trend(log: DataFrame, at: str, value: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(bucket_start, sample_count, mean): tumbling windows; rows later than `late` are left out."""
    w = F.window(at, width)
    rows = log.withWatermark(at, late).groupBy(w).agg(F.count("*").alias("sample_count"), F.avg(value).alias("mean"))
    return rows.select(F.unix_timestamp("window.start").alias("bucket_start"), "sample_count", "mean")


def sliding_cost(usage: DataFrame, at: str = "called_at", cost: str = "cost", late: str = "1 hour") -> DataFrame:
    """(start, cost): the paid cost of every 24 hours, moving on by one hour."""
    w = F.window(at, "24 hours", "1 hour")
    rows = usage.filter("success").withWatermark(at, late).groupBy(w).agg(F.sum(cost).alias("cost"))
    return rows.select(F.unix_timestamp("window.start").alias("start"), "cost")


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, n): runs of a user's events that lie less than `gap` apart."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(user, w).agg(F.count("*").alias("n")).select(user, F.unix_timestamp("session_window.start").alias("start"), "n")


def job_states(jobs: DataFrame) -> DataFrame:
    """(doc_id, status, job_id, n): the latest state of each document's jobs; a row of state for each document."""
    last = F.max_by(F.struct("status", "job_id"), F.struct("queued_at", "job_id")).alias("r")
    return jobs.groupBy("doc_id").agg(last, F.count("*").alias("n")).select("doc_id", "r.status", "r.job_id", "n")


def drain(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns its result as a table.

    In complete mode the last batch is the result, in update mode the last row of each key,
    in append mode all that came.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").drop("batch")
    if mode == "append":
        return rows.drop("_batch")
    if key is None:
        return rows.join(F.broadcast(rows.agg(F.max("_batch").alias("_batch"))), "_batch").drop("_batch")
    rest = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])
