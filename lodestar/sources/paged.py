"""Format `paged`: a table read in pages of its key, as a batch and as a stream.

Options: `path`, a folder or file of Parquet; `key`, a column of whole numbers; `page`, keys
in a page (1000); `run`, pages in a partition (16); `columns`, names parted by commas, all
by default.  The statistics of the files bound the keys, so planning reads no rows.
Comparisons with the key narrow the pages that there are; other equalities are evaluated
where a page is read.  Rows without a key come last, in a partition of their own.

As a stream the offset is the greatest key read; what is appended with greater keys comes
in later batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Pages(InputPartition):
    """Pages of keys low <= key < high; none for the rows without a key."""

    low: int | None
    high: int | None


class _Table:
    """The files, and what of them is asked for."""

    def __init__(self, options: dict):
        path = options["path"]
        self.path = urlsplit(path).path if path.startswith("file:") else path
        self.key, self.page, self.run = options["key"], int(options.get("page", 1000)), int(options.get("run", 16))
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None

    def dataset(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet")

    def schema(self) -> StructType:
        arrow = self.dataset().schema
        arrow = pa.schema([arrow.field(c) for c in self.columns]) if self.columns else arrow
        # Instants are read as Spark reads them from Parquet: in microseconds.
        micro = [f.with_type(pa.timestamp("us", "UTC" if f.type.tz else None)) if pa.types.is_timestamp(f.type) else f for f in arrow]
        return from_arrow_schema(pa.schema(micro))

    def bounds(self) -> tuple[int | None, int | None, bool]:
        """Least and greatest key, and whether there may be rows without one, from the files' statistics."""
        low, high, nulls = None, None, False
        for piece in self.dataset().get_fragments():
            meta = piece.metadata
            at = meta.schema.names.index(self.key) if self.key in meta.schema.names else None
            for g in range(meta.num_row_groups):
                s = next(c.statistics for c in map(meta.row_group(g).column, range(meta.num_columns)) if c.path_in_schema == self.key)
                if s is None or not s.has_min_max:
                    nulls = True
                    if s is None:
                        column = piece.to_table(columns=[self.key]).column(0)
                        lo, hi = (pc.min(column).as_py(), pc.max(column).as_py()) if at is not None else (None, None)
                    else:
                        lo = hi = None
                else:
                    lo, hi, nulls = s.min, s.max, nulls or not s.has_null_count or s.null_count > 0
                low, high = min((x for x in (low, lo) if x is not None), default=None), max((x for x in (high, hi) if x is not None), default=None)
        return low, high, nulls

    def runs(self, low: int | None, high: int | None) -> list[Pages]:
        """Partitions of whole pages over low <= key <= high."""
        if low is None or high is None or high < low:
            return []
        step = self.page * self.run
        return [Pages(max(a, low), min(a + step, high + 1)) for a in range(low // step * step, high + 1, step)]

    def read(self, part: Pages | None, kinds: pa.Schema, equal: list[tuple[str, object]]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition, a page at a time."""
        if part is None:
            return
        key, table = pc.field(self.key), self.dataset()
        for low in [None] if part.low is None else range(part.low // self.page * self.page, part.high, self.page):
            kept = key.is_null() if low is None else (key >= max(low, part.low)) & (key < min(low + self.page, part.high))
            for name, value in equal:
                kept &= pc.field(name) == value
            for batch in table.scanner(columns=kinds.names, filter=kept).to_batches():
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(kinds.field(n).type, safe=False) for n in kinds.names], schema=kinds)


class PagedReader(DataSourceReader):
    def __init__(self, table: _Table, schema: StructType):
        self.table, self.schema = table, schema
        self.low: int | None = None
        self.high: int | None = None
        self.present = False
        self.equal: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == (self.table.key,)
            if isinstance(f, IsNotNull) and own:
                self.present = True
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and own and isinstance(f.value, int):
                self.present = True
                low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
                high = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}.get(type(f))
                self.low = max((x for x in (self.low, low) if x is not None), default=None)
                self.high = min((x for x in (self.high, high) if x is not None), default=None)
            elif isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (int, str)) and not isinstance(f.value, bool):
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        low, high, nulls = self.table.bounds()
        low = low if self.low is None or low is None else max(low, self.low)
        high = high if self.high is None or high is None else min(high, self.high)
        return self.table.runs(low, high) + ([Pages(None, None)] if nulls and not self.present else [])

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from self.table.read(partition, to_arrow_schema(self.schema), self.equal)


class PagedStream(DataSourceStreamReader):
    def __init__(self, table: _Table, schema: StructType):
        self.table, self.schema = table, schema

    def initialOffset(self) -> dict:
        low, _, _ = self.table.bounds()
        return {"key": None if low is None else low - 1}

    def latestOffset(self) -> dict:
        _, high, _ = self.table.bounds()
        return {"key": high}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        low, high = start["key"], end["key"]
        return self.table.runs((self.table.bounds()[0] if low is None else low + 1), high)

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from self.table.read(partition, to_arrow_schema(self.schema), [])

    def commit(self, end: dict) -> None:
        """Nothing is kept: a batch can be read again from its offsets."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        return _Table(self.options).schema()

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(_Table(self.options), schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(_Table(self.options), schema)
