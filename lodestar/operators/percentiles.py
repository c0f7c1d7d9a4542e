"""The four percentile rules, by name, without a sort of whole groups.

A place in a group is found by narrowing.  Values get an order-preserving 64-bit key (the
bits of a double, so that a far outlier takes one binade and not the range).  A first pass
counts each group by the key's top bits; further passes count the rows between the least
and greatest key of the range that holds the place, cut into BINS; so a range narrows by
the counts reached, whatever the spread, until it holds ENOUGH rows or one key.  Only those
rows are put in order.  Each pass is one scan whose counts are combined before the shuffle.

`nearest` and `rounded` take an element, `interpolated` lies between two, `interpolated_int` is
the same rule as a whole number.  `linear` and `continuous_int` are aggregates of the same
rules, for groups that are small: they hold a group's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType

#: Ranges that a pass cuts the rows around a place into.
BINS = 4096
#: Rows that may be put in order in one task.
ENOUGH = 100_000
#: Most (group, place) pairs whose ranges are kept by the driver and broadcast: about 1 MB.
MAX_STATE = 10_000
#: Parts of a group where there are more.
SALTS = 16


def order_key(x: Column, kind: DataType) -> Column:
    """A bigint in the order of x: equal for equal values, NaN last.  Of doubles the bits, mirrored below zero."""
    if isinstance(kind, IntegralType):
        return x.cast("bigint")
    d = x.cast("double")
    a = F.abs(d)
    # log2 may be off by one at a power of two; the quotient by a power is exact and tells.
    rough = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022)).cast("double")
    m = a / F.pow(F.lit(2.0), rough)
    e = rough + F.when(m >= 2, 1.0).when((m < 1) & (rough > -1022), -1.0).otherwise(0.0)
    m = a / F.pow(F.lit(2.0), e)
    exact = (e.cast("bigint") + 1023) * F.lit(1 << 52) + ((m - 1) * F.lit(float(1 << 52))).cast("bigint")
    small = (m * F.lit(float(1 << 52))).cast("bigint")
    bits = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(2047 << 52)).when(m < 1, small).otherwise(exact)
    return F.when(F.isnan(d), F.lit((1 << 63) - 1)).when(d < 0, -bits).otherwise(bits)


Places = dict[str, Callable[[Column], Column]]


def _held(bins: DataFrame, names: list[str], places: Places) -> DataFrame:
    """Of a first count (_names, _bin, _in, _low, _high): the range of each place, with n and the rows before it."""
    w = Window.partitionBy(*names)
    upto = F.sum("_in").over(w.orderBy("_bin"))
    held = bins.withColumn("n", F.sum("_in").over(w)).withColumn("_before", upto - F.col("_in"))
    at = F.array(*[F.struct(F.lit(k).alias("which"), p(F.col("n")).cast("bigint").alias("place")) for k, p in places.items()])
    own = F.filter(at, lambda x: (x.place >= F.col("_before")) & (x.place < F.col("_before") + F.col("_in")))
    return held.withColumn("_at", F.explode(own)).select(*names, "_at.*", "n", "_before", "_in", "_low", "_high")


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], parts: int) -> DataFrame:
    """The same after one more pass: rows between _low and _high cut into BINS."""
    near = _within(rows, state, names, parts)
    # A range may span more than a bigint holds; its width is taken as a decimal.
    wide = F.floor((F.col("_high").cast("decimal(20,0)") - F.col("_low")) / BINS).cast("decimal(20,0)") + 1
    bin_ = F.floor((F.col("_k").cast("decimal(20,0)") - F.col("_low")) / wide).cast("bigint")
    counts = near.groupBy(*names, "which", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_k").alias("_l"), F.max("_k").alias("_h"), F.first("n").alias("n"), F.first("place").alias("place"), F.first("_before").alias("_b"))
    upto = F.sum("_c").over(Window.partitionBy(*names, "which").orderBy("_bin"))
    found = counts.withColumn("_before", F.col("_b") + upto - F.col("_c")).filter("place >= _before AND place < _before + _c")
    return found.select(*names, "which", "place", "n", "_before", F.col("_c").alias("_in"), F.col("_l").alias("_low"), F.col("_h").alias("_high"))


def _within(rows: DataFrame, state: DataFrame, names: list[str], parts: int) -> DataFrame:
    """The rows of every (group, place) in its range; beyond MAX_STATE each group is joined in `parts`."""
    if parts == 1:
        return rows.join(F.broadcast(state), names).filter("_k BETWEEN _low AND _high")
    salted = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(parts)).cast("int")).join(salted, [*names, "_salt"]).filter("_k BETWEEN _low AND _high").drop("_salt")


def _element(rows: DataFrame, by: list[str], value: str, places: Places) -> DataFrame:
    """One row for each group: n and, for each name, the value at a 0-based place that depends on n."""
    spark = rows.sparkSession
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_{c}") for c in by] or [F.lit("").alias("_")]
    names = [f"_{c}" for c in by] or ["_"]
    base = rows.filter(F.col(value).isNotNull()).select(*by, value, *key, order_key(F.col(value), rows.schema[value].dataType).alias("_k"))
    counts = base.groupBy(*names, F.shiftright("_k", 49).alias("_bin")).agg(F.count("*").alias("_in"), F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    state, parts = _held(counts, names, places), 1
    first = state.limit(MAX_STATE + 1).collect()
    if len(first) > MAX_STATE:
        state, parts = _narrowed(base, state, names, SALTS), SALTS
    else:
        kind, known = state.schema, first
        while any(r["_in"] > ENOUGH and r["_low"] < r["_high"] for r in known):
            known = _narrowed(base, spark.createDataFrame(known, kind).select(state.columns), names, 1).select(state.columns).collect()
        state = spark.createDataFrame(known, kind)
    counted = _within(base, state, names, parts).groupBy(*by, *names, "which", value).agg(F.count("*").alias("_c"), F.first("n").alias("n"), F.first("place").alias("place"), F.first("_before").alias("_before"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*names, "which").orderBy(value))
    ranked = counted.withColumn("_upto", upto).filter(F.col("_upto") > F.col("place"))
    return ranked.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("which") == k, F.col(value))).alias(k) for k in places])


def nearest(rows: DataFrame, by: list[str], value: str, **quantiles: float) -> DataFrame:
    """sorted[floor(q * (n - 1))] for each named q."""
    return _element(rows, by, value, {k: lambda n, q=q: F.floor(F.lit(q) * (n - 1)) for k, q in quantiles.items()})


def rounded(rows: DataFrame, by: list[str], value: str, **quantiles: float) -> DataFrame:
    """sorted[round(q * (n - 1))], halves to even, for each named q."""
    return _element(rows, by, value, {k: lambda n, q=q: F.bround(F.lit(q) * (n - 1)) for k, q in quantiles.items()})


def interpolated(rows: DataFrame, by: list[str], value: str, **quantiles: float) -> DataFrame:
    """Linear interpolation at q * (n - 1), as a double, for each named q; groups without values give no row."""
    place = lambda n, q: F.lit(q) * (n - 1)
    places = {f"{k}_{side}": (lambda n, q=q, f=f: f(place(n, q))) for k, q in quantiles.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = _element(rows, by, value, places)
    share = lambda q: place(F.col("n"), q) - F.floor(place(F.col("n"), q))
    low, high = (lambda k: F.col(f"{k}_low").cast("double")), (lambda k: F.col(f"{k}_high").cast("double"))
    return found.select(*by, "n", *[F.when(low(k) == high(k), low(k)).otherwise(low(k) * (1 - share(q)) + high(k) * share(q)).alias(k) for k, q in quantiles.items()])


def interpolated_int(rows: DataFrame, by: list[str], value: str, **quantiles: float) -> DataFrame:
    """percentile_cont as whole numbers, halves to even."""
    found = interpolated(rows, by, value, **quantiles)
    return found.select(*by, "n", *[F.rint(k).cast("int").alias(k) for k in quantiles])


def linear(value: str, q: float) -> Column:
    """Linear interpolation at q * (n - 1)."""
    return F.percentile(F.col(value), q)


def continuous_int(value: str, q: float) -> Column:
    """percentile_cont as a whole number, halves to even, 0 without values."""
    return F.coalesce(F.rint(F.percentile(F.col(value), q)), F.lit(0)).cast("int")
