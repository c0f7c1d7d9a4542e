"""Joins with defaults, spines, caches and fuzzy keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(text: str) -> Column:
    """sha256 of the trimmed text."""
    return F.sha2(F.trim(F.col(text)).cast("binary"), 256)


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the cache's value, null where it has none."""
    return rows.join(cache.select(key, value).dropDuplicates([key]), key, "left")


def misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows that the cache does not know."""
    return rows.join(cache.select(key), key, "left_anti")


def plan_of(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The plan of each user: `free` without a subscription or with a canceled one."""
    s = subscriptions.select("user_id", F.col("plan").alias("_plan"), F.col("status").alias("_status"))
    plan = F.when(F.col("_plan").isNull() | (F.col("_status") == "canceled"), "free").otherwise(F.col("_plan"))
    return users.join(s, "user_id", "left").withColumn("plan", plan).drop("_plan", "_status")


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each day, both ends included."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(span).alias("day"))


def buckets(spark: SparkSession, start: str, end: str, seconds: int) -> DataFrame:
    """(bucket_start): epoch-aligned buckets from start to end, both included."""
    unix = lambda x: F.unix_timestamp(F.lit(x).cast("timestamp"))
    floor = lambda x: (F.floor(unix(x) / seconds) * seconds).cast("bigint")
    return spark.range(1).select(F.explode(F.sequence(floor(start), unix(end), F.lit(seconds).cast("bigint"))).alias("bucket_start"))


def zero_fill(spine: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row of the spine, with 0 where there is no count."""
    out = spine.join(counts, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def _plain(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def split_titles(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row for each title of a list parted by bars."""
    return rows.select(F.explode(F.split(column, r"\|")).alias(name))


#: Plain characters that a title needs to be found inside another one.
LEAST = 8


def fuzzy_titles(asked: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The best document of each title: equal, else equal without decoration, else one inside the
    other (LEAST plain characters or more); ties by id.

    All tiers are equi-joins.  A title inside a document's shares its first LEAST characters with
    a window of that title; a document's title inside an asked one equals one of its parts.
    """
    q = asked.select(name, _plain(F.col(name)).alias("_plain")).distinct()
    d = docs.select("doc_id", "title", _plain(F.col("title")).alias("_key"))
    equal = q.join(d, q["_plain"] == d["_key"]).withColumn("_tier", F.when(F.lower(F.col(name)) == F.lower("title"), 1).otherwise(2))
    size = F.char_length("_key")
    windows = F.transform(F.sequence(F.lit(1), size - LEAST + 1), lambda i: F.substring(F.col("_key"), i, F.lit(LEAST)))
    cut = d.filter(size >= LEAST).withColumn("_on", F.explode(F.array_distinct(windows)))
    open_ = q.filter(F.char_length("_plain") >= LEAST)
    outer = cut.join(open_.withColumn("_on", F.left("_plain", F.lit(LEAST))), "_on").filter(F.contains("_key", "_plain"))
    n = F.char_length("_plain")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n - LEAST + 1), lambda i: F.transform(F.sequence(F.lit(LEAST), n - i + 1), lambda k: F.substring(F.col("_plain"), i, k))))
    inner = open_.withColumn("_part", F.explode(F.array_distinct(parts))).join(d, F.col("_part") == F.col("_key"))
    part = outer.select(name, "doc_id").unionByName(inner.select(name, "doc_id")).withColumn("_tier", F.lit(3))
    both = equal.select(name, "doc_id", "_tier").unionByName(part)
    return both.groupBy(name).agg(F.min(F.struct("_tier", "doc_id")).alias("_x")).select(name, F.col("_x.doc_id").alias("doc_id"))


def blob_path(user: str, text: str, ext: str) -> Column:
    """user/<id>/<sha256>.<extension>"""
    return F.concat(F.lit("user/"), F.col(user), F.lit("/"), F.sha2(F.col(text).cast("binary"), 256), F.lit("."), F.col(ext))


def mailed(mails: DataFrame, addresses: DataFrame, kind: Callable[[Column], Column]) -> DataFrame:
    """(mail_id, idx, owner, status, path) of every attachment, over mails (mail_id, token, attachments array<struct<name, content>>).

    A token that no address (token, owner) has is refused, a name whose `kind` is null is not
    taken, and of equal contents of one owner the first by (mail_id, idx) is ingested, the
    others are duplicates.  First ones are an aggregate that combines before the shuffle.
    """
    files = mails.select("mail_id", "token", F.posexplode("attachments").alias("idx", "file")).select("mail_id", "token", "idx", "file.name", F.sha2(F.col("file.content").cast("binary"), 256).alias("sha"))
    files = files.join(addresses.select("token", "owner"), "token", "left").withColumn("_taken", F.col("owner").isNotNull() & kind(F.col("name")).isNotNull())
    first = files.filter("_taken").groupBy("owner", "sha").agg(F.min(F.struct("mail_id", "idx")).alias("_first"))
    rows = files.join(first, ["owner", "sha"], "left")
    again = F.struct("mail_id", "idx") != F.col("_first")
    status = F.when(F.col("owner").isNull(), "unknown_token").when(~F.col("_taken"), "not_allowed").when(again, "duplicate").otherwise("ingested")
    ext = F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1))
    path = F.when(status == "ingested", F.concat(F.lit("user/"), "owner", F.lit("/"), "sha", ext))
    return rows.select("mail_id", "idx", "owner", status.alias("status"), path.alias("path"))
