"""Operator 10: benchmark decontamination.

The benchmark's word windows form a hash set that is broadcast behind a check of its
size; every document's windows are looked up in one narrow scan and each hit is
verified word by word, beside the row that it is in.  A benchmark beyond the bound is
sifted by a bitmap of fixed size instead; the windows that pass are joined with those of
the benchmark, which verifies them, and what is found goes back to the rows by the hash
of their text.  Both ways give the same rows.

A window is `n` consecutive words of an item; an item with fewer words, but not none,
is one window.  Null and empty texts have no words: no hits as documents, no windows
as items.  Equal windows of several items count for all of them.  Rows are judged each
by itself, whether their ids are repeated, null or not, and very long texts whole.  An
empty benchmark hits nothing; no documents give no rows.  Other columns are not read,
whatever they are called, and stay in `clean_text`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.llm import words as W
from lodestar.llm.sieve import Sieve
from lodestar.llm.storage import free, saved

WINDOW = 13
#: Most windows in the broadcast set: about 100 bytes each.
MAX_WINDOWS = 500_000
_RANGE = pa.struct([(c, pa.int64()) for c in ("start", "end", "from", "to")])
#: What a scan gives for a text, for Spark and for Arrow.
_HITS = (
    "n_words bigint, n_hit bigint, hits array<struct<start: bigint, end: bigint, from: bigint, to: bigint>>, items array<string>",
    pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(_RANGE)), ("items", pa.list_(pa.string()))]),
)
_SPOTS = (
    "n_words bigint, spots array<struct<size: int, hash: bigint, start: bigint, from: bigint, to: bigint, window: binary>>",
    pa.struct([("n_words", pa.int64()), ("spots", pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("start", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("window", pa.binary())])))]),
)


def windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, hash, item, window): the distinct windows of every item, as folded bytes."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for at, _, texts in W.chunks(batch, "_text"):
                w = W.words(texts, W.ALNUM)
                out = []
                for size in {min(n, int(c)) for c in w.count} - {0}:
                    where, hashes = w.windows(size)
                    for i, h in zip(where.tolist(), hashes.view(np.int64).tolist()):
                        doc = int(np.searchsorted(w.first, i, side="right")) - 1
                        if size == min(n, w.first[doc + 1] - w.first[doc]):
                            out.append((size, h, ids[at + doc], folded(w, i, size)))
                yield pa.RecordBatch.from_pydict({k: pa.array([x[j] for x in out], t) for j, (k, t) in enumerate((("size", pa.int32()), ("hash", pa.int64()), ("item", pa.string()), ("window", pa.binary())))})

    return rows.mapInArrow(cut, "size int, hash bigint, item string, window binary").distinct()


def folded(w: W.Words, at: int, size: int) -> bytes:
    """The words at:at + size as bytes, folded, parted by blanks."""
    return b" ".join(w.data[s:e] for s, e in zip(w.starts[at : at + size].tolist(), w.ends[at : at + size].tolist())).lower()


class Lookup:
    """A hash set of windows: sorted hashes, then the words themselves, of an Arrow table of `windows`."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("size", "ascending"), ("hash", "ascending")])
        self.window, self.item = rows.column("window").combine_chunks(), rows.column("item").combine_chunks()
        sizes, hashes = rows.column("size").to_numpy(), rows.column("hash").to_numpy()
        self.parts = {}
        for k in np.unique(sizes).tolist():
            at = int(np.searchsorted(sizes, k))
            self.parts[k] = (at, hashes[at : int(np.searchsorted(sizes, k, side="right"))])

    def hits(self, w: W.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(word index, size, items) of every occurrence."""
        for k, (first, known) in self.parts.items():
            at, h = w.windows(k)
            h = h.view(np.int64)
            low = np.searchsorted(known, h)
            found = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            for i, p, x in zip(at[found].tolist(), low[found].tolist(), h[found].tolist()):
                words, items = folded(w, i, k), []
                while p < len(known) and known[p] == x:
                    if self.window[first + p].as_py() == words:
                        items.append(self.item[first + p].as_py())
                    p += 1
                if items:
                    yield i, k, items


def _found(lookup: Lookup, texts: list[bytes | None]) -> list[dict]:
    """Of each text the number of words, the hit word and byte ranges, and the items."""
    w = W.words(texts, W.ALNUM)
    spots: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for i, k, names in lookup.hits(w):
        d = int(np.searchsorted(w.first, i, side="right")) - 1
        spots[d].append((i, i + k))
        items[d].update(names)
    out = []
    for d, each in enumerate(spots):
        base, merged = int(w.first[d]), []
        for start, end in sorted(each):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        hits = [{"start": s - base, "end": e - base, "from": int(w.starts[s] - w.begin[d]), "to": int(w.ends[e - 1] - w.begin[d])} for s, e in merged]
        out.append({"n_words": int(w.count[d]), "n_hit": sum(e - s for s, e in merged), "hits": hits, "items": sorted(items[d])})
    return out


def _sifted(sizes: list[int], sieve: Sieve, texts: list[bytes | None]) -> list[dict]:
    """Of each text the number of words and the windows that may be in the benchmark."""
    w = W.words(texts, W.ALNUM)
    spots: list[list[dict]] = [[] for _ in texts]
    for k in sizes:
        at, h = w.windows(k)
        h = h.view(np.int64)
        maybe = sieve.passes(h)
        for i, x in zip(at[maybe].tolist(), h[maybe].tolist()):
            d = int(np.searchsorted(w.first, i, side="right")) - 1
            spots[d].append({"size": k, "hash": x, "start": i - int(w.first[d]), "from": int(w.starts[i] - w.begin[d]), "to": int(w.ends[i + k - 1] - w.begin[d]), "window": folded(w, i, k)})
    return [{"n_words": int(n), "spots": x} for n, x in zip(w.count, spots)]


def _scan(text: Column, shared, read: Callable, kind: tuple[str, pa.DataType]) -> Column:
    """What `read` makes of the broadcast value and the texts, as a struct."""

    @F.arrow_udf(kind[0])
    def scan(text: pa.Array) -> pa.Array:
        batch, found = pa.RecordBatch.from_arrays([text], names=["t"]), []
        for _, _, texts in W.chunks(batch, "t"):
            found += read(shared.value, texts)
        return pa.array(found, kind[1])

    return scan(text)


def beside(docs: DataFrame, benchmark: DataFrame, name: str, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` with a column `name` more: a struct of n_words, n_hit, hits (word and byte ranges) and items."""
    context, rows = docs.sparkSession.sparkContext, saved(windows(benchmark, n, item_col), "windows")
    if rows.count() <= max_windows:
        shared = context.broadcast(Lookup(rows.toArrow()))
        return docs.withColumn(name, _scan(F.col(text_col), shared, _found, _HITS))
    # The rows meet again by 128 bits of their text: equal texts have equal hits.
    shared, sizes = context.broadcast(Sieve(rows.select(F.col("hash").alias("key")))), [r["size"] for r in rows.select("size").distinct().collect()]
    h1, h2, spots, found = free(docs, "_h1", "_h2", "_spots", "_found")
    hashes = {h1: F.xxhash64(text_col), h2: F.xxhash64(F.lit(7), text_col)}
    read = docs.withColumns(hashes).withColumn(spots, _scan(F.col(text_col), shared, lambda sieve, texts: _sifted(sorted(sizes), sieve, texts), _SPOTS))
    read = saved(read, "sifted")
    spot = read.filter(F.size(f"{spots}.spots") > 0).select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.explode(f"{spots}.spots").alias("s")).select("h1", "h2", "s.*").distinct()
    true = spot.join(rows, ["size", "hash", "window"])
    words = true.groupBy("h1", "h2", "start", "size", "from", "to").agg(F.count("*").alias("n"))
    last = Window.partitionBy("h1", "h2").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("size")).over(last)
    run = words.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = run.groupBy("h1", "h2", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.min("from").alias("from"), F.max("to").alias("to"))
    hits = ranges.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from", "to"))).alias("hits"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    names = true.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    every = saved(hits.join(names, ["h1", "h2"]).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.struct("n_hit", "hits", "items").alias(found)), "hits")
    out = read.join(every, (F.col(h1) == F.col("k1")) & (F.col(h2) == F.col("k2")), "left").drop("k1", "k2")
    of = F.col(found)
    whole = F.struct(F.col(f"{spots}.n_words").alias("n_words"), F.coalesce(of.n_hit, F.lit(0)).alias("n_hit"), F.coalesce(of.hits, F.array()).alias("hits"), F.coalesce(of["items"], F.array()).alias("items"))
    return out.withColumn(name, whole).select(*docs.columns, name)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """For each row of `docs`: id, n_words, n_hit, hits (word and byte ranges), items."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return beside(rows, benchmark, "_m", n, "_text", item_col, max_windows).select(F.col("_id").alias(id_col), "_m.*")


def is_contaminated(m: str = "", percent: int = 5) -> Column:
    """A document is contaminated when `percent` or more of its words are hit."""
    n_hit, n_words = F.col(f"{m}n_hit"), F.col(f"{m}n_words")
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of `find`: counts, the items' hash and the verdict."""
    id_col = options.get("id_col", "doc_id")
    return find(docs, benchmark, **options).select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@F.arrow_udf(StringType())
def _without(text: pa.Array, hits: pa.Array) -> pa.Array:
    """The texts without the byte ranges of their hits."""
    out = []
    for t, ranges in zip(text.cast(pa.binary()).to_pylist(), hits.to_pylist()):
        for h in reversed(ranges or []):
            t = t[: h["from"]] + t[h["to"] :]
        out.append(t)
    return pa.array([x if x is None else x.decode() for x in out], pa.string())


def clean_text(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) with all hit spans cut
    out: decided and cut in the scan that finds the hits, so no id matters."""
    (m,) = free(docs, "_m")
    found = beside(docs, benchmark, m, n, text_col, item_col, max_windows)
    if remove == "documents":
        return found.filter(~is_contaminated(f"{m}.")).select(docs.columns)
    return found.withColumn(text_col, _without(F.col(text_col), F.col(f"{m}.hits"))).select(docs.columns)
