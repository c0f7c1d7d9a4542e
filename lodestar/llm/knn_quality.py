"""Operator 8: a quality classifier by nearest-neighbour voting.

Texts become hashed counts of terms (their words, byte shapes in threes, repetition),
weighted by how rare the terms are among the labelled rows, then vectors of a latent
semantic space (a truncated SVD of the labelled rows by subspace iteration).  The labelled
vectors are broadcast; every document's exact cosine to each of them is computed in
blocks, and the `neighbours` nearest vote with their cosine as weight; ties at the last
place fall to either.

The labelled rows and the space come from a bounded sample: the `sample` labelled rows
with the lowest hash of their id, outside the held-out fold.  So the broadcast is at most
`sample` x `dims` float32 and `BUCKETS` x `dims` (2 MB at the defaults).  All documents are
scored, whole, and very long ones alike.

Null and empty texts, and all without a word, score 0: nothing speaks for them.  Without
any labelled row every score is 0.  Repeated rows and ids are scored row by row; of rows
that share a labelled id the least text is learned, with several labels once for each.
An empty table gives no rows.  Only text and, for fitting, the label are read, whatever
other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words as W

#: Hashed terms: words in the first half, shapes and repetition in the second.
BUCKETS = 4096
SAMPLE = 4096
DIMS = 64
NEIGHBOURS = 15
FOLDS = 5
#: Rounds of the subspace iteration that finds the axes.
ROUNDS = 6


def _shapes() -> np.ndarray:
    """Bytes by kind: small, capital, digit, beyond ASCII; blanks and signs stand for themselves."""
    kind = np.arange(256, dtype=np.uint64)
    kind[0x61:0x7B] = 0x61
    kind[0x41:0x5B] = 0x41
    kind[0x30:0x3A] = 0x30
    kind[0x80:] = 0x61
    return kind


_SHAPE = _shapes()


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of float32 for each text: log counts of its words, of byte shapes in threes, of
    the same with runs as one, and of new and repeated words and word triples."""
    w = W.words(texts, W.LOWER)
    n = len(texts)
    terms = _count(w.text, w.hashes, n, 0)
    row = np.repeat(np.arange(n), np.diff(w.begin))[: len(w.raw)]
    shape = _SHAPE[w.raw]
    if len(shape) >= 3:
        tri = shape[:-2] * np.uint64(65536) + shape[1:-1] * np.uint64(256) + shape[2:]
        terms += _count(row[:-2], tri, n, 1)
        turn = np.flatnonzero(np.concatenate([[True], (shape[1:] != shape[:-1]) | (row[1:] != row[:-1])]))
        run, where = shape[turn], row[turn]  # "Aaaa bb," counts as "Aa a,"
        if len(run) >= 3:
            terms += _count(where[:-2], run[:-2] * np.uint64(65536) + run[1:-1] * np.uint64(256) + run[2:] + np.uint64(1 << 32), n, 1)
    for k in (1, 3):
        at, h = w.windows(k)
        text = w.text[at]
        _, before = W.row_counts(W.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        terms += _count(text, np.minimum(before, 1).astype(np.uint64) + np.uint64((k + 1) << 40), n, 1)
    return np.log1p(terms.reshape(n, BUCKETS)).astype(np.float32)


def _count(row: np.ndarray, code: np.ndarray, n: int, half: int) -> np.ndarray:
    """Counts of hashed terms in one half of the buckets."""
    bucket = (W.mix(code * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS // 2)).astype(np.int64)
    return np.bincount(row * BUCKETS + bucket + half * (BUCKETS // 2), minlength=n * BUCKETS)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 1e-9, size, 1)


@dataclass(frozen=True)
class Model:
    """A latent space, and the labelled vectors in it."""

    weight: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space of rows of `features`."""
        return _unit((_unit(x * self.weight) - self.mean) @ self.axes)

    def scores(self, texts: list[bytes | None], block: int = 128) -> np.ndarray:
        """The labels of the nearest neighbours, weighted by their cosine."""
        out, k = np.zeros(len(texts)), min(self.neighbours, len(self.labels))
        for at in range(0, len(texts) if k else 0, block):
            part = texts[at : at + block]
            x = features(part)
            near = self.place(x) @ self.vectors.T
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0)
            total = weight.sum(axis=1)
            vote = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + block] = np.where(x[:, : BUCKETS // 2].any(axis=1), vote, 0)
        return np.clip(out, 0, 1)


def learn(x: np.ndarray, y: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS) -> Model:
    """The model of rows of `features` and their labels: terms weighted by their rarity among
    the rows, unit length, and the `dims` main axes of what is left."""
    found = (x > 0).sum(axis=0)
    weight = np.log1p(len(x) / np.maximum(found, 1)).astype(np.float32)
    x = _unit(x * weight)
    mean = x.mean(axis=0) if len(x) else np.zeros(BUCKETS, np.float32)
    x -= mean
    axes = np.random.default_rng(1).standard_normal((BUCKETS, dims + 8)).astype(np.float32)
    for _ in range(ROUNDS):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    values, turn = np.linalg.eigh(axes.T @ (x.T @ (x @ axes)))
    axes = (axes @ turn[:, np.argsort(values)[::-1][:dims]]).astype(np.float32)
    return Model(weight, mean, axes, _unit(x @ axes), y, neighbours)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _vectorised(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.select("label", F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text", 1 << 20):
                x = features(texts)
                yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(at, end - at), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})

    return rows.mapInArrow(run, "label int, x binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, dims: int = DIMS, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from the labelled rows outside fold 0; the driver gets `sample` vectors, one for each label of an id."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    chosen = usable.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_key"), "_key", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_key").filter(F.length("_text") > 0)
    got = _vectorised(texts.groupBy("_key", "label").agg(F.min("_text").alias("_text")), "_text").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], dtype=np.float32).reshape(len(got), BUCKETS)
    y = np.array([r["label"] for r in got], dtype=np.float32)
    order = np.lexsort([x @ np.linspace(1, 2, BUCKETS, dtype=np.float32), y])  # the same model whatever the order of rows
    return learn(x[order], y[order], dims, neighbours)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text", 2 << 20):
                yield pa.RecordBatch.from_pydict({"_id": batch.column("_id").slice(at, end - at), "score": pa.array(shared.value.scores(texts), pa.float64())})

    out = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
