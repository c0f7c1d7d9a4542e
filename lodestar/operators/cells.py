"""Vectors stored in cells, and exact top-k that reads only the cells that can matter.

Each vector lies in the folder of its nearest centroid, and a small table keeps every
cell's centroid, radius and rows.  No vector of a cell is nearer to a query than the
centroid's angle less the radius, which bounds its cosine.  A search reads the likeliest
cells of each query first, and then those whose bound reaches its k-th cosine so far; all
others are never read.  Centroids are fitted on a sample, every vector is stored, and the
result does not depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import QUERY_BYTES, ROWS, _Top

#: Vectors that centroids are fitted on: those of the smallest hash of their id.
SAMPLE = 20_000
#: Most cells: centroids of 64 doubles take 2 MB.
MAX_CELLS = 4096
#: Rows, in times of k, of the cells that a query reads first.
FIRST = 4
_ROUNDS = 8


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.stack(lists.to_numpy(zero_copy_only=False))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Vectors that have a direction."""
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.exists("vec", lambda x: x != 0))


def fit(vectors: DataFrame, cells: int, id_col: str = "doc_id", vec_col: str = "vec", sample: int = SAMPLE) -> np.ndarray:
    """Centroids by spherical k-means on a bounded sample; fewer where the sample has fewer rows."""
    rows = _rows(vectors, id_col, vec_col)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec")
    if not len(drawn):
        return np.zeros((0, 0))
    x = _unit(drawn.combine_chunks())
    centers = x[: min(cells, MAX_CELLS)].copy()
    for _ in range(_ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(size > 0, total / np.maximum(size, 1e-300), centers)
    return centers


def append(vectors: DataFrame, path: str, centers: np.ndarray, id_col: str = "doc_id", vec_col: str = "vec") -> None:
    """Adds vectors to the index at `path`; those without a direction are like nothing and are left out."""
    rows = _rows(vectors, id_col, vec_col)
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dot = _unit(batch.column("vec")) @ shared.value.T
                cell = dot.argmax(axis=1)
                angle = np.arccos(np.clip(dot[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "vec", "cell", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, vec array<double>, cell int, angle double")
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    stored = vectors.sparkSession.read.parquet(f"{path}/rows")
    center = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(F.broadcast(center), "cell").write.mode("overwrite").parquet(f"{path}/cells")


def bounds(q: np.ndarray, centers: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest cosine that a vector of each cell can have with each query."""
    angle = np.arccos(np.clip(q @ centers.T, -1, 1)) - radius[None, :]
    return np.where(angle <= 0, 1.0, np.cos(np.minimum(angle, np.pi))) + 1e-8


def _scored(rows: DataFrame, names: pa.Array, q: np.ndarray, asked: dict[int, np.ndarray], k: int, kinds: str) -> DataFrame:
    """Each task's k best of every query, among the cells that it asks for."""
    shared = rows.sparkSession.sparkContext.broadcast((names, q, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, asked = shared.value
        top, kind = _Top(len(names), k), None
        for batch in batches:
            kind = batch.column("id").type
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                for part in (at[i : i + ROWS] for i in range(0, len(at), ROWS)):
                    block = batch.take(pa.array(part))
                    score = np.round(_unit(block.column("vec")) @ q[asked[cell]].T, 9)
                    top.add(score, block.column("id").to_numpy(zero_copy_only=False), of=asked[cell])
        if kind is not None:
            yield top.batch(names, kind, pa.float64(), "sim")

    return rows.filter(F.col("cell").isin([int(c) for c in asked])).mapInArrow(best, kinds)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "doc_id") -> tuple[DataFrame, dict]:
    """(query_id, id, sim, rank) as `retrieval.dense`, and what was read: rows and cells, and (query, cell) pairs scored and in all.

    Queries are taken in blocks of QUERY_BYTES; the k-th cosines after the first cells are
    all that comes back to the driver, a row for each query."""
    stored = spark.read.parquet(f"{path}/rows")
    known = spark.read.parquet(f"{path}/cells").toArrow()
    centers, radius, size = np.stack(known.column("center").to_numpy()), known.column("radius").to_numpy(), known.column("n").to_numpy()
    number = known.column("cell").to_numpy()
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, sim double"
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-(sizes["n"] or 0) * (sizes["d"] or 1) * 8 // QUERY_BYTES))
    out, seen = None, {"pairs": 0, "pairs_scored": 0, "cells": len(number), "cells_read": 0, "rows": int(size.sum()), "rows_read": 0}
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        names, q = part.column("query_id").combine_chunks(), _unit(part.column("vec").combine_chunks())
        most = bounds(q, centers, radius)
        order = np.argsort(-most, axis=1, kind="stable")
        enough = np.cumsum(size[order], axis=1) - size[order] < FIRST * k
        first = np.zeros_like(enough)
        np.put_along_axis(first, order, enough, axis=1)
        begun = _scored(stored, names, q, _by_cell(first, number), k, kinds)
        w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
        ranked = begun.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == k).select("query_id", "sim").toArrow()
        floor = np.full(len(q), -np.inf)
        place = {n: i for i, n in enumerate(names.to_pylist())}
        for n, s in zip(ranked.column("query_id").to_pylist(), ranked.column("sim").to_pylist()):
            floor[place[n]] = s
        more = (most >= floor[:, None]) & ~first
        found = begun
        if more.any():
            found = found.unionByName(_scored(stored, names, q, _by_cell(more, number), k, kinds))
        read = (first | more).any(axis=0)
        seen["pairs"] += most.size
        seen["pairs_scored"] += int((first | more).sum())
        seen["cells_read"] = max(seen["cells_read"], int(read.sum()))
        seen["rows_read"] = max(seen["rows_read"], int(size[read].sum()))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], kinds)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("id", id_col), seen


def _by_cell(pairs: np.ndarray, number: np.ndarray) -> dict[int, np.ndarray]:
    return {int(number[c]): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(axis=0))}
