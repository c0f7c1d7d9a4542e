"""Rankings and neighbours within groups.  Every order ends in a key, so ranks are certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each group: an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c != by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(by).agg(best).select(by, *[F.col("_row")[c].alias(c) for c in rest])


def top_per(rows: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def max_normalised(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Value by the greatest of all, at most 1, to four places: one broadcast row, no global window."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(value).alias("_top")))).withColumn(name, F.round(F.least(F.lit(1.0), F.col(value) / F.col("_top")), 4)).drop("_top")


def adjacent_boost(rows: DataFrame, by: str, index: str, score: str, factor: float) -> DataFrame:
    """The greater of a row's score and `factor` times its best neighbour's.

    Neighbours are rows whose index differs by one: a gap parts them, so the join is by
    index and not by order.  Scores are read before any of them changes.
    """
    near = rows.select(by, F.explode(F.array(F.col(index) - 1, F.col(index) + 1)).alias(index), F.col(score).alias("_near"))
    near = near.groupBy(by, index).agg(F.max("_near").alias("_near"))
    return rows.join(near, [by, index], "left").withColumn(score, F.greatest(F.col(score), F.coalesce(F.col("_near") * factor, F.lit(0.0)))).drop("_near")


#: Ranges that `numbered` parts the rows into.
RANGES = 256


#: Rows that the bounds of string ranges are taken from, those of the smallest hash.
SAMPLE = 16_384


def _ranged(rows: DataFrame, order: str) -> DataFrame:
    """Rows with `_b`, the range of a key that they are in.

    The bounds are one row: approximate quantiles of numbers, and of strings those of a bounded
    sample of rows, whole strings, so that keys with a common beginning are parted too.  They
    hang on the rows alone and are the same wherever they are used."""
    key = F.col(order)
    if isinstance(rows.schema[order].dataType, StringType):
        plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        drawn = rows.filter(key.isNotNull()).select(key.alias("_key"), F.xxhash64(*plain).alias("_hash")).orderBy("_hash", "_key").limit(SAMPLE)
        known = F.array_sort(F.collect_list("_key"))
        at = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("_known", F.floor(i * F.size("_known") / RANGES).cast("int")))
        bounds = drawn.agg(known.alias("_known")).select(F.filter(at, lambda x: x.isNotNull()).alias("_bounds"))
    else:
        bounds = rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("_bounds"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("_b", F.size(F.filter("_bounds", lambda x: x < key))).drop("_bounds")


def numbered(rows: DataFrame, order: str, name: str, first: str | None = None) -> DataFrame:
    """Rows numbered from 0 by `first` and a number or string, with `_total`, without a sort in one task:
    a range's number of rows gives the next one its offset, and rows are sorted within a range."""
    own = [c for c in (first, "_b") if c]
    parts = _ranged(rows, order)
    sizes = parts.groupBy(*own).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(*own)  # a row for each range
    before = sizes.select(*own, (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(order)) - 1
    return parts.withColumn("_k", place).join(before, own).withColumn(name, F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def round_robin(rows: DataFrame, by: str, order: list[Column], place: str = "place") -> DataFrame:
    """Groups interleaved: all first rows, then all second rows; within a round by group."""
    ranked = rows.withColumn("_round", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered(ranked, by, place, "_round").withColumn(place, F.col(place) + 1).drop("_round", "_total")


def even_stride(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even steps in order of a key."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: F.floor(F.col("_total") / n * g + F.col("_total") / (2 * n)))
    return numbered(rows, order, "_i").filter(F.array_contains(steps, F.col("_i"))).select(rows.columns)


def sliding_sum(rows: DataFrame, by: str, at: str, value: str, seconds: int, name: str) -> DataFrame:
    """The sum over the `seconds` before and at each row."""
    w = Window.partitionBy(by).orderBy(F.unix_timestamp(at)).rangeBetween(-seconds, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def majority(rows: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group, the least on a tie."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))
