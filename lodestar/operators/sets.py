"""Set operations: differences, precedence, ordered distinct values, interval unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose keys `right` lacks."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti").select(left.columns)


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, those of `first`."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def ordered_distinct(rows: DataFrame, by: str, item: str, order: str) -> DataFrame:
    """(by, items): distinct items of each group, by their first place."""
    first = rows.groupBy(by, item).agg(F.min(order).alias("_at"))
    packed = F.array_sort(F.collect_list(F.struct("_at", item)))
    return first.groupBy(by).agg(F.transform(packed, lambda x: x[item]).alias("items"))


def merged_intervals(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each group as one."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= before, 0).otherwise(1)
    islands = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
