"""Keyed tables that can be written again and again: upsert, insert-ignore, delete, conditional update.

A table is a folder of Parquet in BUCKETS folders by the hash of its parent column.  A write
reads only the buckets that its rows fall into, resolves each key, and replaces just these
folders (dynamic partition overwrite, committed as one job).  Every row carries the batch
that wrote it, and the greatest batch of a key wins, so a batch that is replayed, as after
a lost executor or a restarted stream, changes nothing, and neither does an older one that
comes late.  Deleted keys stay as marks, for the same reason.

Of rows with one key in one batch the greatest by all its columns wins.  Keys with a null in
them are keys too.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

BUCKETS = 64
_OWN = ("_batch", "_gone", "_bucket")


class KeyedTable:
    """A table of `schema` at `path` with unique `keys`; `parent`, one of them, tells the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], parent: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.parent, self.buckets = spark, path, schema, keys, parent or keys[0], buckets

    def _stored(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        kinds = StructType([*self.schema.fields]).add("_batch", LongType()).add("_gone", BooleanType()).add("_bucket", IntegerType())
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(self.path)

    def read(self) -> DataFrame:
        """The rows that are there."""
        return self._stored().filter("NOT _gone").select(self.schema.names)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.parent), F.lit(self.buckets)).cast("int"))

    def _touched(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """New rows with their bucket, and the stored rows of these buckets."""
        new = self._bucketed(rows)
        buckets = [r[0] for r in new.select("_bucket").distinct().collect()]
        return new, self._stored().filter(F.col("_bucket").isin(buckets)) if buckets else self._stored().limit(0)

    def _replace(self, rows: DataFrame) -> None:
        kept = rows.select(*self.schema.names, *_OWN)
        kept.repartition("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def _resolved(self, rows: DataFrame, first: bool) -> DataFrame:
        """One row for each key: an aggregate that combines before the shuffle."""
        rest = [c for c in (*self.schema.names, *_OWN) if c not in (*self.keys, "_bucket")]
        order = F.struct((-F.col("_batch") if first else F.col("_batch")).alias("b"), *[F.col(c) for c in rest if c != "_batch"])
        best = rows.groupBy(*self.keys, "_bucket").agg(F.max_by(F.struct(*rest), order).alias("_r"))
        return best.select(*self.keys, "_bucket", *[F.col("_r")[c].alias(c) for c in rest])

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Each key's row of the greatest batch."""
        new, old = self._touched(rows.select(self.schema.names).withColumns({"_batch": F.lit(batch).cast("bigint"), "_gone": F.lit(False)}))
        self._replace(self._resolved(old.unionByName(new), first=False))

    def insert_ignore(self, rows: DataFrame, batch: int) -> None:
        """Each key's row of the first batch."""
        new, old = self._touched(rows.select(self.schema.names).withColumns({"_batch": F.lit(batch).cast("bigint"), "_gone": F.lit(False)}))
        self._replace(self._resolved(old.unionByName(new), first=True))

    def delete(self, parents: DataFrame, batch: int) -> None:
        """All rows of these parents (a column of the parent's name) that an earlier batch, or this one, wrote."""
        gone = parents.select(self.parent).distinct()
        known, old = self._touched(gone)
        marked = old.join(known.select(self.parent).withColumn("_hit", F.lit(True)), self.parent, "left")
        hit = F.coalesce("_hit", F.lit(False)) & (F.col("_batch") <= batch)
        self._replace(marked.withColumn("_gone", F.col("_gone") | hit).withColumn("_batch", F.when(hit, F.lit(batch)).otherwise(F.col("_batch")).cast("bigint")))

    def update(self, where: Column, values: dict[str, Column], batch: int) -> int:
        """Sets `values` in the rows that fit when they are written; gives the number of rows.

        Only buckets that hold one are replaced, and a row that fits no longer is left alone, so
        the update can be repeated."""
        fits = where & ~F.col("_gone")
        buckets = {r["_bucket"]: r["n"] for r in self._stored().filter(fits).groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        if buckets:
            rows = self._stored().filter(F.col("_bucket").isin(list(buckets)))
            now = {c: F.when(fits, v).otherwise(F.col(c)) for c, v in values.items()}
            self._replace(rows.select(*[now.get(c, F.col(c)).alias(c) for c in self.schema.names], F.when(fits, F.lit(batch)).otherwise(F.col("_batch")).cast("bigint").alias("_batch"), "_gone", "_bucket"))
        return sum(buckets.values())


def stream_into(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """Starts a query that upserts every batch of a stream under its own number; a batch that is run again changes nothing."""
    return stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
