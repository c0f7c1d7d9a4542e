"""Operator 13: hard-negative mining by dual-tree search.

Anchors and candidates stand in ball trees of their own.  Of two nodes the centers and
radii give an interval that holds every inner product between them, so a pair of nodes is
dropped, whole anchor group against whole candidate group, when the interval lies outside
of all scores that could still count.  Pairs of leaves that are left are scored exactly.

Anchors, the stated query set, are taken in blocks of ANCHORS rows, whose tree is broadcast
(ANCHORS x 64 components: 16 MB).  Every task searches its rows, batch by batch, with a tree
for each batch, and keeps the k best of each anchor, so what is shuffled is k rows for each
anchor and task at most; bounds from the block's own leaves, whose anchors are rows of the
table too, drop most of those.  A block takes two passes over the table: one for the
positives, whose scores then bound the negatives of the other.  Each pass is written to the
shared folder.

Scores are sums of whole numbers, exact in 64 bits.  Rows with a null id, label or vector,
or a component that is null, not finite or LIMIT or more in size once scaled, take no part;
of vectors of unequal lengths the missing components count 0.  Ties fall to the smaller id.
Anchors that are equal in id, label and vector are one anchor, other rows that are repeated
count each for itself; a row of the anchor's own id is never its positive or negative.
Empty tables and anchors without positives or negatives give no rows.  Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.storage import free, saved

#: Anchors of a block.
ANCHORS = 65_536
#: Rows of a leaf.
LEAF = 64
#: Anchors of the node whose members give a leaf its first bounds.
NEAR = 1024
#: Pairs of nodes whose intervals are computed at once.
PAIRS = 16_384
#: Components of this size or more are left out: sums of 128 products stay within 64 bits.
LIMIT = 1 << 27


class Tree:
    """A ball tree over the rows of x: node i holds order[start[i]:end[i]]; children follow their parent."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        start, end, left, right, center, radius = [0], [len(x)], [], [], [], []
        i = 0
        while i < len(start):
            own = self.order[start[i] : end[i]]
            rows = x[own]
            center.append(rows.mean(axis=0))
            away = np.linalg.norm(rows - center[-1], axis=1)
            radius.append(float(away.max()))
            left.append(-1)
            right.append(-1)
            if len(own) > leaf and radius[-1] > 0:
                a = rows[int(away.argmax())]
                b = rows[int(np.linalg.norm(rows - a, axis=1).argmax())]
                half = len(own) // 2
                self.order[start[i] : end[i]] = own[np.argpartition(rows @ (b - a), half)]
                left[i], right[i] = len(start), len(start) + 1
                start += [start[i], start[i] + half]
                end += [start[i] + half, end[i]]
            i += 1
        self.start, self.end, self.left, self.right = (np.array(v) for v in (start, end, left, right))
        self.center, self.radius = np.array(center), np.array(radius)
        self.size = np.linalg.norm(self.center, axis=1)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of the rows of each node."""
        ordered = values[self.order]
        return np.array([ordered[a:b].min() for a, b in zip(self.start, self.end)])


def leaf_pairs(a: Tree, b: Tree, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves, as arrays of nodes, that `keep` leaves: it is told nodes of both trees and
    the bounds of the inner products between their rows.  Depth first, PAIRS pairs at a time."""
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        u, v = stack.pop()
        if len(u) > PAIRS:
            stack.append((u[PAIRS:], v[PAIRS:]))
            u, v = u[:PAIRS], v[:PAIRS]
        middle = np.einsum("ij,ij->i", a.center[u], b.center[v])
        reach = a.radius[u] * b.size[v] + b.radius[v] * a.size[u] + a.radius[u] * b.radius[v]
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-3  # what rounding may hide
        left = keep(u, v, middle - reach, middle + reach)
        u, v = u[left], v[left]
        ends_u, ends_v = a.left[u] < 0, b.left[v] < 0
        ends = ends_u & ends_v
        if ends.any():
            yield u[ends], v[ends]
        first = ~ends & ~ends_u & (ends_v | (a.radius[u] >= b.radius[v]))
        second = ~ends & ~first
        if first.any():
            stack.append((np.concatenate([a.left[u[first]], a.right[u[first]]]), np.tile(v[first], 2)))
        if second.any():
            stack.append((np.tile(u[second], 2), np.concatenate([b.left[v[second]], b.right[v[second]]])))


def matrix(lists: pa.Array, width: int | None, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, rows of `width` components: longer rows are cut, shorter ones filled with 0."""
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width))
    fits = place < width
    out[np.repeat(np.arange(len(size)), size)[fits], place[fits]] = flat[fits]
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by floating point where its sums are exact, else as integers."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(x.shape[1], 1) < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


_NONE = np.iinfo(np.int64).min


class Best:
    """The k best (greatest score, least id) of each of n queries so far, and the least score that still counts."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor.copy()
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple] = []

    def offer(self, queries: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of `queries`, a column for each of `ids`, which ascend; those not
        allowed do not count.  Of each row k are noted at most, however many are equal."""
        floor = self.floor[queries]
        allowed = allowed & (scores >= floor[:, None])
        if scores.shape[1] > self.k and (many := np.flatnonzero(allowed.sum(axis=1) > self.k)).size:
            best = np.partition(np.where(allowed[many], scores[many], _NONE), scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            floor[many] = np.maximum(floor[many], best)
            over, tied = allowed[many] & (scores[many] > best[:, None]), allowed[many] & (scores[many] == best[:, None])
            allowed[many] = over | (tied & (np.cumsum(tied, axis=1) <= self.k - over.sum(axis=1)[:, None]))
            self.floor[queries[many]] = floor[many]
        row, column = np.nonzero(allowed)
        if len(row):
            self.more.append((queries[row], scores[row, column], ids[column]))

    def settle(self) -> None:
        """Keeps the k best of what was offered, and raises the scores that count."""
        if not self.more:
            return
        query, score, ids = (np.concatenate([old, *new]) for old, new in zip((self.query, self.score, self.id), zip(*self.more)))
        self.more = []
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[order][keep], ids[order][keep]
        last = place[keep] == self.k - 1
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])


class Block:
    """A block of anchors with its tree, and once they are known their positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.labels, self.x, self.k = ids, labels, x, k
        self.tree = Tree(x)
        self.low, self.high = self.tree.least(labels), -self.tree.least(-labels)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each leaf's rows, beside those of the greatest node over it with NEAR rows at most."""
        tree, over = self.tree, np.arange(len(self.tree.left))
        for i in range(len(over)):
            if tree.left[i] < 0:
                yield tree.rows(i), np.sort(tree.rows(over[i]))
                continue
            for child in (tree.left[i], tree.right[i]):
                over[child] = over[i] if tree.end[i] - tree.start[i] <= NEAR else child


def _labels_of(tree: Tree, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tree.least(labels), -tree.least(-labels)


def _positives(block: Block, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray) -> Best:
    best = Best(len(block.ids), block.k, floor)
    for ids, labels, x in batches:
        tree = Tree(x)
        low, high = _labels_of(tree, labels)
        bound = block.tree.least(best.floor)
        keep = lambda u, v, least, most: (most >= bound[u]) & (block.low[u] <= high[v]) & (low[v] <= block.high[u])  # noqa: B023, E731
        for rows, near in _grouped(block.tree, tree, keep):
            score = products(block.x[rows], x[near])
            best.offer(rows, score, (block.labels[rows][:, None] == labels[near]) & (block.ids[rows][:, None] != ids[near]), ids[near])
        best.settle()
    return best


def _negatives(block: Block, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray, most_of: np.ndarray) -> Best:
    """Queries are slots: slot s of anchor a is number a * positives + s; `floor` and `most_of` hold the scores that count for each."""
    n = block.k
    best = Best(len(block.ids) * n, k, floor)
    open_most = most_of.reshape(-1, n).max(axis=1, initial=_NONE)
    for ids, labels, x in batches:
        tree = Tree(x)
        low, high = _labels_of(tree, labels)
        bound = block.tree.least(best.floor.reshape(-1, n).min(axis=1))
        limit = -block.tree.least(-np.maximum(open_most, -(1 << 62)))
        same = lambda u, v: (block.low[u] == block.high[u]) & (low[v] == high[v]) & (block.low[u] == low[v])  # noqa: B023, E731
        keep = lambda u, v, least, most: (most >= bound[u]) & (least <= limit[u]) & ~same(u, v)  # noqa: B023, E731
        for rows, near in _grouped(block.tree, tree, keep):
            score = products(block.x[rows], x[near])
            other = (block.labels[rows][:, None] != labels[near]) & (block.ids[rows][:, None] != ids[near])
            for s in range(n):
                slots = rows * n + s
                best.offer(slots, score, other & (score <= most_of[slots][:, None]), ids[near])
        best.settle()
    return best


def _grouped(a: Tree, b: Tree, keep: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a leaf of `a`, and in ascending order rows of leaves of `b` that are left beside it."""
    for u, v in leaf_pairs(a, b, keep):
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        cut = np.flatnonzero(np.diff(u)) + 1
        for leaf, leaves in zip(u[np.append(0, cut)], np.split(v, cut)):
            yield a.rows(leaf), np.sort(np.concatenate([b.rows(i) for i in leaves]))


def _scaled(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, which ascend within a batch, labels and scaled vectors."""
    for batch in batches:
        if batch.num_rows:
            batch = batch.take(pa.compute.sort_indices(batch.column("id")))
            yield batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vec"), width, scale)


def _usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    fits = F.forall(F.col(vec_col), lambda x: F.abs(x.cast("double")) * scale < LIMIT - 1)
    label = F.col(label_col) if vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(label_col)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & fits)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vec_col).alias("vec"))


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every anchor its first `positives` rows of the same label, and for each of these the
    first `negatives` rows of other labels whose score is at least `low` and at most `high`
    percent of the positive's.  Ids are whole numbers; labels of other kinds are compared by
    a 64-bit hash.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, label_col, vec_col, scale)
    (is_anchor,) = free(vectors, "_anchor")
    asked = _usable(vectors.withColumn(is_anchor, anchor).filter(F.col(is_anchor)), id_col, label_col, vec_col, scale)
    asked = saved(asked.dropDuplicates(["id", "label", "vec"]), "anchors")
    blocks = -(-asked.count() // ANCHORS)
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if part.num_rows:
            done = _mined(rows, part, positives, negatives, low, high, scale).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            done = saved(done, "negatives")
            out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], kinds) if out is None else out


def _mined(rows: DataFrame, part: pa.Table, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    part = part.sort_by("id").combine_chunks()
    x = matrix(part.column("vec").chunk(0), None, scale)
    block = Block(part.column("id").to_numpy(), part.column("label").to_numpy(), x, positives)
    n, width = len(block.ids), x.shape[1]

    floor = _seeds(block, None, None)
    shared = context.broadcast((block, floor))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floor = shared.value
        best = _positives(block, _scaled(batches, width, scale), floor)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.score), pa.array(best.id)], names=["query", "score", "id"])

    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(same, "query bigint, score bigint, id bigint").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives).toArrow()
    slot = found.column("query").to_numpy() * positives + found.column("rank").to_numpy() - 1
    score, of = np.full(n * positives, _NONE), np.zeros(n * positives, np.int64)
    score[slot], of[slot] = found.column("score").to_numpy(), found.column("id").to_numpy()
    # 100 * s lies between low * p and high * p; a slot without a positive admits nothing.
    least = np.where(score > _NONE, -(-low * score // 100), np.iinfo(np.int64).max)
    most = np.where(score > _NONE, high * score // 100, _NONE)
    shared2 = context.broadcast((block, _seeds(block, least, most), most, score, of))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floor, most, score, of = shared2.value
        best = _negatives(block, _scaled(batches, width, scale), negatives, floor, most)
        q = best.query
        columns = [q, block.ids[q // positives], of[q], score[q], best.id, best.score]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    kinds = "query bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    first = Window.partitionBy("query").orderBy(F.desc("negative_score"), "negative_id")
    return rows.mapInArrow(others, kinds).withColumn("rank", F.row_number().over(first).cast("int")).filter(F.col("rank") <= negatives)


def _seeds(block: Block, least: np.ndarray | None, most: np.ndarray | None, k: int = 5) -> np.ndarray:
    """Scores that the last row that counts reaches at least, from the anchors near each anchor:
    these are rows of the table, so that k of them that fit bound the k best of all."""
    k = block.k if least is None else k
    best = Best(len(block.ids) * (1 if least is None else block.k), k, np.full(len(block.ids), _NONE) if least is None else least)
    for rows, near in block.near():
        score = products(block.x[rows], block.x[near])
        same, other = block.labels[rows][:, None] == block.labels[near], block.ids[rows][:, None] != block.ids[near]
        if least is None:
            best.offer(rows, score, same & other, block.ids[near])
            continue
        for s in range(block.k):
            slots = rows * block.k + s
            best.offer(slots, score, ~same & other & (score <= most[slots][:, None]), block.ids[near])
    best.settle()
    return best.floor
