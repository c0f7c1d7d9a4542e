"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts or pages that a Python worker gets at once.
BATCH_ROWS = 1000
#: The folders written so far by the operator that is at work.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir.  Where that is unset, a local session takes
    the machine's temporary folder; a cluster has no folder that all of it sees, so there
    it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/lodestar"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most while a table is written; then what was set before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet and read again: computed once, and its lineage ends here."""
    path = folder(df.sparkSession, label)
    if (written := _written.get()) is not None:
        written.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that `saved` wrote, before the operator that wrote it ends."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        removed(table.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """After a table is written, the shuffle files of what made it are of no use.  Spark removes them
    once the driver's collector has found that nothing refers to them, so that is run here."""
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `saved` wrote, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(label: str) -> Callable:
    """Of an operator that returns a DataFrame: its result becomes a table in the shared
    folder, and the tables that it wrote on the way are removed.  Within another such
    operator it hands on its plan as it is."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            if _written.get() is not None:
                return f(docs, *args, **options)
            way: list[str] = []
            token = _written.set(way)
            try:
                out = f(docs, *args, **options)
            finally:
                _written.reset(token)
            try:
                return saved(out, label)
            finally:
                for path in way:
                    removed(docs.sparkSession, path)

        return run

    return wrap


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until `df` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _text): the id beside a hash of the text, so that rows which share an id, or have
    none, are told apart.  Rows equal in both are one document."""
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("_doc"), F.col(text_col).alias("_text"))
