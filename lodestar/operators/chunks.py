"""Chunks of documents: packing, merging, overlap, filtering and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T


def marked(chunks: DataFrame) -> DataFrame:
    """Chunks with the reason for which the search leaves them out, null for the others.

    Repeats are counted by an aggregate over short texts alone, which combines before the
    shuffle; long texts do not move.
    """
    bare = F.trim(F.col("text"), F.lit(" \t\r\n"))
    short = chunks.filter(F.char_length(bare) < T.REPEAT_CHARS).groupBy("doc_id", F.xxhash64(bare).alias("_h")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= T.REPEATS)
    joined = chunks.withColumn("_h", F.when(F.char_length(bare) < T.REPEAT_CHARS, F.xxhash64(bare))).join(short, ["doc_id", "_h"], "left")
    return joined.withColumn("reason", T.filtered_reason(F.col("text"), F.coalesce("_n", F.lit(0)))).drop("_h", "_n")


def rollup(marked_chunks: DataFrame) -> DataFrame:
    """(total, filtered, warning, breakdown): counts by reason, and whether more than 5 % are left out."""
    by = marked_chunks.groupBy("reason").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string")))))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("filtered"), F.array_join(pairs, ",").alias("breakdown"))
    return out.select("total", "filtered", F.coalesce(F.col("filtered") / F.nullif("total", F.lit(0)) > 0.05, F.lit(False)).alias("warning"), "breakdown")


def statistics(chunks: DataFrame) -> DataFrame:
    """(doc_id, n, mean_chars, median_chars, filled, noisy) of every document."""
    n = F.char_length("text")
    noisy = (T.short_line_ratio(F.col("text")) >= 0.7) & (T.digit_ratio(F.col("text")) >= 0.5)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(n), 1).alias("mean_chars"), F.percentile(n, 0.5).cast("int").alias("median_chars"), F.round(F.avg((n >= 400).cast("double")), 3).alias("filled"), F.round(F.avg(noisy.cast("double")), 3).alias("noisy"))


def overlapped(pieces: DataFrame, chars: int = 100, most: int = 1000) -> DataFrame:
    """(doc_id, idx, text): each piece led by the end of the piece before it, while both fit."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    room = F.least(F.lit(chars), most - F.char_length("text") - 1)
    led = F.when((room > 0) & before.isNotNull(), F.concat(F.right(before, room), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return pieces.withColumn("text", led)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text): the pieces of every text by sentence packing."""
    return docs.select("doc_id", F.posexplode(T.packed(F.col("text"))).alias("idx", "text"))


def _is_cell(text: str) -> bool:
    """Whether a section reads like a table's cell: a bar between blanks, or short and half of it signs and digits."""
    return " | " in text or (len(text) < 30 and 2 * sum(not (c.isalpha() or c.isspace()) for c in text) >= max(1, len(text)))


def merged(sections: DataFrame, least: int = 200, most: int = 1000) -> DataFrame:
    """(doc_id, idx, page, title, text): short sections of one page joined to the next while both fit.

    Table cells stay apart, and so do sections without a page.  Null texts count as empty ones.
    A fold in reading order: documents are dealt by range and sorted within their partition
    (Spark sorts on disk where it must), and a task folds them batch by batch.  It holds the
    open section, `most` characters, and a batch, however long a document is.
    """
    rows = sections.select(F.col("doc_id").cast("bigint"), F.col("idx").cast("int"), F.col("page").cast("int"), "title", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "idx", "page", "title", "text"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, n, last = object(), 0, None
        for batch in batches:
            out: list[tuple] = []
            for d, page, title, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "title", "text"))):
                if d != doc:
                    if last:
                        out.append((doc, n, *last[:3]))
                    doc, n, last = d, 0, None
                cell = _is_cell(text)
                if last and not cell and not last[3] and page is not None and last[0] == page and len(last[2]) < least and len(last[2]) + 1 + len(text) <= most:
                    last = (page, title or last[1], f"{last[2]}\n{text}", False)
                    continue
                if last:
                    out.append((doc, n, *last[:3]))
                    n += 1
                last = (page, title, text, cell)
            yield _batch(out)
        if last:
            yield _batch([(doc, n, *last[:3])])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=names)

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "idx")
    return ordered.mapInArrow(fold, "doc_id bigint, idx int, page int, title string, text string")


def routed(items: DataFrame, readers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(doc_id, doc_type, idx, text, skipped): each item (doc_id, doc_type, content) through the reader of its type,
    a column function that gives its sections; one of another type gives a row that says why it was skipped.

    One plan for each reader over its own items alone, and their union."""
    out = items.filter(~F.coalesce(F.col("doc_type").isin(list(readers)), F.lit(False))).select("doc_id", "doc_type", F.lit(0).alias("idx"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), F.coalesce("doc_type", F.lit("null"))).alias("skipped"))
    for kind, reader in readers.items():
        rows = items.filter(F.col("doc_type") == kind).select("doc_id", "doc_type", F.posexplode(reader(F.col("content"))).alias("idx", "text"))
        out = out.unionByName(rows.withColumn("skipped", F.lit(None).cast("string")))
    return out


def sticky_headings(lines: DataFrame) -> DataFrame:
    """Lines with the last heading before or at them, in reading order."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w))


def columns_of_page(spans: DataFrame, gap: float = 4.0) -> DataFrame:
    """(page, columns): clusters of left edges that lie further apart than `gap`."""
    edges = spans.select("page", "x").distinct()
    new = F.when(F.col("x") - F.lag("x").over(Window.partitionBy("page").orderBy("x")) <= gap, 0).otherwise(1)
    return edges.withColumn("_new", new).groupBy("page").agg(F.sum("_new").alias("columns"))


def exact_duplicates(docs: DataFrame, owner: str = "user_id") -> DataFrame:
    """(owner, doc_id, duplicate_of): later documents whose text the owner has already."""
    keyed = docs.select(owner, "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    first = keyed.groupBy(owner, "_sha").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(first, [owner, "_sha"]).filter("doc_id <> duplicate_of").select(owner, "doc_id", "duplicate_of")


def gate(marked_chunks: DataFrame, image_kinds: DataFrame) -> DataFrame:
    """(doc_id, has_pii, has_watermark, hits, third_party) over (doc_id, pii, hits) of chunks and (doc_id, image_kind)."""
    told = marked_chunks.groupBy("doc_id").agg(F.bool_or("pii").alias("has_pii"), F.bool_or(F.size("hits") > 0).alias("has_watermark"))
    hits = marked_chunks.select("doc_id", F.explode("hits").alias("hit")).groupBy("doc_id").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    every = told.join(hits, "doc_id", "left").join(image_kinds, "doc_id", "left")
    return every.select("doc_id", "has_pii", "has_watermark", F.coalesce("hits", F.array().cast("array<string>")).alias("hits"), F.coalesce(F.col("image_kind") == "메신저대화", F.lit(False)).alias("third_party"))
