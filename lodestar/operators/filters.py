"""Predicates over documents, tenants, dates and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import patterns


def tenant(docs: DataFrame, user_id: str | None, user_col: str = "user_id", deleted_col: str = "deleted_at") -> DataFrame:
    """Rows of one tenant (None: of all) that are not deleted."""
    live = docs.filter(F.col(deleted_col).isNull())
    return live if user_id is None else live.filter(F.col(user_col) == user_id)


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Row security by EXISTS: rows whose key is among the owners' keys."""
    return rows.join(owners.select(key), key, "left_semi")


def has_all(column: str, wanted: list[str]) -> Column:
    """The array holds every wanted value."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(column))) == 0


def between_inclusive(column: str, start: str, end: str) -> Column:
    """Both ends count; a date alone is its midnight, so the last day is its first instant only."""
    return F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def between_half_open(column: str, start: str, end: str) -> Column:
    """The start counts, the end does not."""
    return (F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp"))


def title_contains(column: str, keyword: str) -> Column:
    """Case-insensitive; % and _ in the keyword stand for themselves."""
    safe = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{safe}%")


def title_prefixed(column: str, prefixes: list[str]) -> Column:
    """The title starts with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out |= F.startswith(F.col(column), F.lit(p))
    return out


def is_public(title: Column, prefixes: list[str], keywords: list[str]) -> Column:
    """A composed title that starts with a prefix or holds a keyword, blanks and underscores alike."""
    plain = F.replace(title, F.lit("_"), F.lit(" "))
    out = F.lit(False)
    for p in prefixes:
        out |= F.startswith(plain, F.lit(p))
    for k in keywords:
        out |= F.contains(plain, F.lit(k))
    return out


def _is_stale(as_of: str, hours: int) -> Column:
    return (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))


def stale_jobs(jobs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Running jobs started more than `hours` before `as_of`; jobs without a start are not stale."""
    return jobs.filter(_is_stale(as_of, hours))


def fail_stale(jobs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """The jobs with stale ones marked failed; the condition is part of the update, so it can be repeated."""
    return jobs.withColumn("status", F.when(_is_stale(as_of, hours), "failed").otherwise(F.col("status")))


def _newest(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The newest k rows of each group, ties by id: cut in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("created_at"), "doc_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def newest_by_facet(docs: DataFrame, facets: DataFrame, k: int) -> DataFrame:
    """(_tags, _title, day, doc_id, created_at): of each facet and day the newest k documents that have all its tags and hold its title.

    A facet is a sorted set of tags and a lower-cased title, either of which may be empty.
    Facets with a title find theirs in one scan of the titles, others meet documents by a tag.
    """
    d = docs.select("doc_id", "created_at", F.to_date("created_at").alias("day"), F.col("tags").alias("_have"), F.lower("title").alias("_named"))
    titled, tagged = facets.filter("_title <> ''"), facets.filter("_title = '' AND size(_tags) > 0")
    hits = patterns.contained(d, titled.select(F.col("_title").alias("key")), "doc_id", F.col("_named"))
    by_title = hits.join(titled, hits["key"] == titled["_title"]).join(d, "doc_id")
    by_tag = d.withColumn("_on", F.explode(F.array_distinct("_have"))).join(tagged.withColumn("_on", F.get("_tags", F.lit(0))), "_on")
    plain = facets.filter("_title = '' AND size(_tags) = 0").limit(1)  # one facet at most: every document
    columns = ["_tags", "_title", "day", "doc_id", "created_at", "_have"]
    rows = by_title.select(columns).unionByName(by_tag.select(columns)).unionByName(d.crossJoin(F.broadcast(plain)).select(columns))
    return _newest(rows.filter(F.size(F.array_except("_tags", "_have")) == 0), ["_tags", "_title", "day"], k).drop("place", "_have")


def by_plan(docs: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """(ask_id, doc_id, place): of each plan (ask_id, start, end, tags, title) the newest k documents
    that have all its tags, a date in its range and its title in their title.

    Plans are few facets, asked many times over: the newest k of each facet and day are found
    once, and a plan takes the best of its days.  So a plan with a common tag meets k documents
    a day, and never all that have the tag.
    """
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    p = plans.select("ask_id", "start", "end", tags.alias("_tags"), F.coalesce(F.lower("title"), F.lit("")).alias("_title"))
    shapes = p.drop("ask_id").distinct()
    facet = ["_tags", "_title"]
    daily = newest_by_facet(docs, shapes.select(facet).distinct(), k)
    dated = shapes.filter("start IS NOT NULL AND end > start").withColumn("day", F.explode(F.sequence("start", F.date_sub("end", 1))))
    columns = ["start", "end", *facet, "doc_id", "created_at"]
    found = dated.join(daily, [*facet, "day"]).select(columns).unionByName(shapes.filter("start IS NULL").join(_newest(daily, facet, k), facet).select(columns))
    best = _newest(found, ["start", "end", *facet], k)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("start", "end", *facet)]
    return p.alias("p").join(best.alias("b"), same).select("ask_id", "doc_id", "place")
