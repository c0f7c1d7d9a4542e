"""Operator 1: substring dedup by MinHash banding of paragraphs, and of word windows.

Near copies.  Texts become paragraphs of their words (A-Z lower-cased): a paragraph ends
with a sentence or a line, and one over `MAX_WORDS` words is cut where the hash of a word
is the least of its neighbourhood.  Paragraphs under `MIN_WORDS` words take no part here.

MinHash signatures over five-word shingles are cut into `BANDS` bands of `ROWS` values.
A pair at similarity 0.8 shares a band with a probability of 1 - (1 - 0.8^2)^5 = 0.994.
Equal paragraphs fold into one first; paragraphs that share a band go through blocks
whose trees verify the exact Jaccard similarity (no pairs are emitted, see
`jaccard_join.links`), and the verified links give components.  Of each component the
earliest occurrence stays, by (id, place); every other one is a copy.

Equal words.  Of every `NEAR_GRAMS` windows of `GRAM` words in a row the one with the least
hash is an anchor, so equal runs of `MIN_SPAN` words or more share one, whatever sentences
and lines they stand in.  An anchor found before, by (id, place), is a copy that grows word
by word to both sides against the earliest place; where it differs from that, it goes on
against the earliest of the places that have the next word too, until no place is left.
So it ends at the edge of the longest equal run: within an equal run the next anchor or
the edge is at most `REACH` words away.  The places of an anchor in one text that have the
same words beside them are one row from the start, however often a text repeats itself.
The rows of an anchor are shuffled once and grow together in one block (`grown`).  An
anchor with more than `HOT` rows is cut into parts in the order of the words beside it
(`equal_runs`): what begins and ends in a part is settled there, and of what goes on beyond
it a part hands on the earliest place, so no task gets a whole one.

Copies that overlap or touch make a span, and no other word is in it; spans of `min_span`
words or more are removed, shorter ones are common phrases and stay.

Null and empty texts have no paragraphs, an empty table gives no rows; texts of any length
are read whole.  Rows that share an id, or have none, are told apart by a hash of their
text and come in the order of that hash; rows equal in both are one document, which is no
copy of itself.  Other columns are not read, whatever their names, and stay in `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import words as W
from lodestar.llm.components import components
from lodestar.llm.jaccard_join import fetch, links, members_of
from lodestar.llm.sieve import Sieve
from lodestar.llm.storage import dropped, finished, free, keyed, saved, swept

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 5, 2
MIN_WORDS, MAX_WORDS, NEAR = 8, 48, 12
MIN_SPAN = 24
GRAM = 8
#: Equal runs of GRAM + NEAR_GRAMS - 1 = MIN_SPAN words share an anchor.
NEAR_GRAMS = MIN_SPAN - GRAM + 1
#: Words beside an anchor that it may grow by; `grow` takes them in pairs.
REACH = NEAR_GRAMS - 1
#: Bytes of text that a task works on at once.
BUDGET = 1 << 20
#: Rows of an anchor that grow in one block, and rows of a block besides those of its last anchor.
HOT, BLOCK_ROWS = 20_000, 40_000
#: Places whose spans are made at once.
CUT_PLACES = 200_000

_SEEDS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STOPS = np.isin(np.arange(256), list(b".!?"))


def _least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of any `width` values in a row, and where the first such one stands; by doubling."""
    low, at, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        at = np.where(low[step:] < low[:-step], at[step:], at[:-step])
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return low, at


def paragraphs(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of every paragraph of MIN_WORDS words or more."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
    last = _STOPS[w.raw[w.ends - 1]]
    last[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
    last[-1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    if ((ends - starts) > MAX_WORDS).any():
        long = np.repeat((ends - starts) > MAX_WORDS, ends - starts)
        h = W.mix(w.hashes + np.uint64(1))
        low = np.pad(h, NEAR, constant_values=np.iinfo(np.uint64).max)
        least = h == _least(low, 2 * NEAR + 1)[0]
        last |= least & long
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], ends[:-1]])
    keep = ends - starts >= MIN_WORDS
    return starts[keep], ends[keep]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices starts[i] .. starts[i] + sizes[i] - 1 in a row, and where each run begins."""
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(first - starts, sizes), first


def _names(w: W.Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each paragraph's words in order."""
    if not len(starts):
        return np.zeros(0, np.int64)
    at, first = _spread(starts, ends - starts)
    place = (np.arange(len(at)) - np.repeat(first, ends - starts)).astype(np.uint64)
    return W.mix(np.add.reduceat(W.mix(w.hashes[at] + place * np.uint64(0x9E3779B97F4A7C15)), first) + (ends - starts).astype(np.uint64)).view(np.int64)


def _grams(w: W.Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all paragraphs in a row, and where each one's begin."""
    n = len(w.hashes) - SHINGLE + 1
    h = W.window_hash([w.hashes[j : n + j] for j in range(SHINGLE)])
    at, first = _spread(starts, ends - starts - SHINGLE + 1)
    return h[at], first


def _sets(texts: list[bytes | None]) -> list[tuple[int, np.ndarray]]:
    w = W.words(texts, W.LOWER)
    starts, ends = paragraphs(w)
    if not len(starts):
        return []
    h, first = _grams(w, starts, ends)
    return [(k, np.unique(x)) for k, x in zip(_names(w, starts, ends).tolist(), np.split(h, first[1:]))]


def _bands(w: W.Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of band keys for each paragraph."""
    h, first = _grams(w, starts, ends)
    least = [np.minimum.reduceat(W.mix(h ^ seed), first) for seed in _SEEDS]
    bands = [W.window_hash([np.full(len(starts), b, np.uint64), *least[b * ROWS : (b + 1) * ROWS]]) for b in range(BANDS)]
    return np.stack(bands, axis=1).view(np.int64)


def anchors(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash of the anchors: the least of any NEAR_GRAMS windows in a row of one text."""
    n = len(w.hashes) - MIN_SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = W.window_hash([w.hashes[j : len(w.hashes) - GRAM + 1 + j] for j in range(GRAM)])
    whole = np.arange(n) + MIN_SPAN <= np.repeat(w.first[1:], w.count)[:n]
    at = np.unique(_least(h, NEAR_GRAMS)[1][whole])
    return at, h[at].view(np.int64)


def _keyed(docs: DataFrame, text_col: str, id_col: str = "_doc") -> DataFrame:
    """(key, sig) of every paragraph's bands, and of every anchor with a number of its own: a hash of
    its row and place, so that a task that is run again gives the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row").to_numpy().view(np.uint64)
            for begin, _, texts in W.chunks(batch, "_text", BUDGET):
                w = W.words(texts, W.LOWER)
                starts, ends = paragraphs(w)
                if len(starts):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(_bands(w, starts, ends).reshape(-1)), "sig": pa.array(np.repeat(_names(w, starts, ends), BANDS))})
                at, key = anchors(w)
                if len(key):
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    sig = W.mix(row[begin + doc] ^ W.mix((at - w.first[doc]).astype(np.uint64)))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key), "sig": pa.array(sig.view(np.int64))})
        pa.default_memory_pool().release_unused()  # the worker waits beside the sorts that follow

    return docs.select(F.xxhash64(id_col).alias("_row"), F.col(text_col).alias("_text")).mapInArrow(run, "key bigint, sig bigint")


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of x as binary values."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def _beside(w: W.Words, at: np.ndarray, step: int) -> np.ndarray:
    """The hashes of the REACH words after (step 1) or before (-1) each anchor, outwards; 0 outside of the text."""
    doc = np.searchsorted(w.first, at, side="right") - 1
    first = at + GRAM if step > 0 else at - 1
    place = first[:, None] + step * np.arange(REACH)
    inside = (place >= w.first[doc][:, None]) & (place < w.first[doc + 1][:, None])
    short = (w.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return short[np.where(inside, place, 0)] * inside.astype(np.uint32)


def _placed(docs: DataFrame, sieve, id_col: str, text_col: str, hot: np.ndarray, only_hot: bool = False) -> DataFrame:
    """(id, ats, key, before, after) of every anchor that may be shared, with the words beside it and all
    places where it has them in a text; without the keys `hot`, or those alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in W.chunks(batch, "_text", BUDGET):
                w = W.words(texts, W.LOWER)
                at, key = anchors(w)
                keep = sieve.value.passes(key)
                if len(hot):
                    keep &= np.isin(key, hot) == only_hot
                at, key = at[keep], key[keep]
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, side="right") - 1
                before, after = _beside(w, at, -1), _beside(w, at, 1)
                same = W.window_hash([doc.astype(np.uint64), key.view(np.uint64), *before.T.astype(np.uint64), *after.T.astype(np.uint64)])
                order = np.argsort(same, kind="stable")
                first = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
                one = order[first]
                ats = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array((at - w.first[doc])[order], pa.int32()))
                ids = batch.column("id").slice(begin, end - begin).take(pa.array(doc[one]))
                yield pa.RecordBatch.from_arrays([ids, ats, pa.array(key[one]), _fixed(before[one]), _fixed(after[one])], names=["id", "ats", "key", "before", "after"])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ats array<int>, key bigint, before binary, after binary")


def _words_of(column: pa.Array) -> np.ndarray:
    """The word hashes of binary values of REACH words each, a row for each value."""
    fixed = column.cast(pa.binary(4 * REACH))
    return np.frombuffer(fixed.buffers()[1], np.uint32).reshape(-1, REACH)[fixed.offset : fixed.offset + len(fixed)]


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Numbers that are equal where all columns are, in the order of the first, then the second, ..."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class _Places:
    """Where the rows of a block stand: `doc` and `place` are in the order of (id, h) and of (id, h, first of ats)."""

    def __init__(self, block: pa.RecordBatch):
        self.ids, ats = block.column("id"), block.column("ats")
        self.flat = ats.flatten().to_numpy().astype(np.int64)
        self.count = pa.compute.list_value_length(ats).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.at, self.last = self.flat[self.first], self.flat[self.first + self.count - 1]
        id_rank = pa.compute.rank(self.ids.field("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        self.doc = _codes(id_rank, self.ids.field("h").to_numpy())
        self.place = _codes(self.doc, self.at)
        self.row_of = np.empty(int(self.place.max()) + 1, np.int64)
        self.row_of[self.place] = np.arange(len(self.place))  # equal places are of one document


def _alike(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How far sorted rows go on as the row before: 1 with the anchor alone, 0 with another anchor."""
    alike = np.column_stack([key[1:] == key[:-1], words[1:] == words[:-1]])
    return np.concatenate([[0], np.logical_and.accumulate(alike, axis=1).sum(axis=1)])


def _homes(p: _Places, rows: np.ndarray, alike: np.ndarray, size: np.ndarray, settled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, home, depth): the rows of the earliest places that the sorted rows are copies of, and up to how many
    words; size: the words before the text ends; settled: so many words (-1: none) are not looked at."""
    home_of, far, out = np.full(len(p.at), -1, np.int64), np.zeros(len(p.at), np.int64), []
    for depth in range(REACH + 1):
        new = np.flatnonzero(alike <= depth)
        shared = np.repeat(np.add.reduceat(p.count[rows], new) > 1, np.diff(np.append(new, len(rows))))
        rows, alike, size = rows[shared], alike[shared], size[shared]
        if not len(rows):
            break
        new = np.flatnonzero(alike <= depth)
        home = p.row_of[np.repeat(np.minimum.reduceat(p.place[rows], new), np.diff(np.append(new, len(rows))))]
        copy = (size >= depth) & ((p.doc[home] != p.doc[rows]) | (p.last[rows] - p.at[home] >= MIN_SPAN))  # a copy does not overlap its source
        if settled is not None:
            copy &= settled[rows] < depth
        row, home = rows[copy], home[copy]
        left = row[(home_of[row] >= 0) & (home_of[row] != home)]
        out.append((left, home_of[left], far[left]))
        home_of[row], far[row] = home, depth
    left = np.flatnonzero(home_of >= 0)
    out.append((left, home_of[left], far[left]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cut(ids: pa.Array, of_doc: pa.Array, flat: np.ndarray, first: np.ndarray, count: np.ndarray, own: np.ndarray, of_at: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, start, end, of_doc): the spans of places flat[first] .. flat[first + count - 1], those that touch as one;
    own: without places that overlap their source `of_at`."""
    part = np.cumsum(count) // CUT_PLACES
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(count)]
    for a, b in zip(edges, edges[1:]):
        at = flat[_spread(first[a:b], count[a:b])[0]]
        row = np.repeat(np.arange(a, b), count[a:b])
        keep = ~own[row] | (at - of_at[row] >= MIN_SPAN)
        at, row = at[keep], row[keep]
        if not len(at):
            continue
        start, end = at - left[row], at + GRAM + right[row]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > end[:-1])))
        end = end[np.append(new[1:], len(row)) - 1]
        row, start = pa.array(row[new]), start[new]
        yield pa.RecordBatch.from_arrays([ids.take(row), pa.array(start, pa.int32()), pa.array(end, pa.int32()), of_doc.take(row)], names=["id", "start", "end", "of_doc"])


def grow(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, start, end, of_doc): of a block that has all rows of its anchors, the words that an earlier
    place has too, around every anchor, once for each document that is the earliest with some of them."""
    p, key = _Places(block), block.column("key").to_numpy()
    found = []
    for side in ("before", "after"):
        words = _words_of(block.column(side))
        pairs = (words[:, ::2].astype(np.uint64) << np.uint64(32)) | words[:, 1::2]
        rows = np.lexsort([*pairs.T[::-1], key])
        found.append(_homes(p, rows, _alike(key[rows], words[rows]), np.logical_and.accumulate(words[rows] != 0, axis=1).sum(axis=1)))
    # Where all places of a row are copies, one span of each goes to both sides.
    reach, every = [], []
    for row, home, depth in found:
        whole = (p.doc[home] != p.doc[row]) | (p.at[row] - p.at[home] >= MIN_SPAN)
        far = np.zeros(len(p.at), np.int64)
        np.maximum.at(far, row[whole], depth[whole])
        reach.append(far)
        every.append(whole)
    row, home = (np.concatenate([x[i][whole] for x, whole in zip(found, every)]) for i in (0, 1))
    _, one = np.unique(row * (int(p.doc.max()) + 1) + p.doc[home], return_index=True)
    parts = [(row[one], home[one], reach[0][row[one]], reach[1][row[one]])]
    for i, ((row, home, depth), whole) in enumerate(zip(found, every)):
        none = np.zeros(len(depth), np.int64)
        parts.append(tuple(x[~whole] for x in (row, home, *((depth, none) if i == 0 else (none, depth)))))
    row, home, left, right = (np.concatenate(x) for x in zip(*parts))
    yield from _cut(p.ids.take(pa.array(row)), p.ids.take(pa.array(home)), p.flat, p.first[row], p.count[row], p.doc[home] == p.doc[row], p.at[home], left, right)


def grown(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`equal_runs` of anchors with HOT rows at most, in one shuffle: blocks of whole anchors."""
    kind = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < block_rows:
                continue
            block = pa.concat_batches(held)
            key = block.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            if whole:
                yield from grow(block.slice(0, whole))
            held = [block.slice(whole)]
        if held:
            yield from grow(pa.concat_batches(held))
        pa.default_memory_pool().release_unused()

    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"id {kind}, start int, end int, of_doc {kind}")


def _groups(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A name of each row's anchor and its first 0, 1, .. REACH words."""
    out = [W.mix(key)]
    for column in words.T:
        out.append(W.mix(out[-1] ^ W.mix(column.astype(np.uint64) + np.uint64(1))))
    return np.stack(out, axis=1).view(np.int64)


def _part(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of a part of the sorted rows: what begins and ends in it, as (id, start, end, of_doc); the rows whose first words
    go on beyond it, as (id, ats, side, names) with the longest such group; and those groups, as (id, ats, names) with
    the earliest place here.  names: of the groups with fewer words, and the group's own; n: its places."""
    p, side, words = _Places(block), block.column("side").to_numpy(), _words_of(block.column("words"))
    key = block.column("key").to_numpy()
    group = _codes(key, side)
    size = np.logical_and.accumulate(words != 0, axis=1).sum(axis=1)
    names = _groups(key.view(np.uint64) ^ W.mix(side.astype(np.uint64)), words)
    ends = [0, len(key) - 1]
    alike = np.stack([np.where(group == group[i], np.logical_and.accumulate(words == words[i], axis=1).sum(axis=1), -1) for i in ends])
    beyond = np.minimum(alike.max(axis=0), size)
    row, home, depth = _homes(p, np.arange(len(key)), _alike(group, words), size, beyond)
    before = side[row] < 0
    for b in _cut(p.ids.take(pa.array(row)), p.ids.take(pa.array(home)), p.flat, p.first[row], p.count[row], p.doc[home] == p.doc[row], p.at[home], np.where(before, depth, 0), np.where(before, 0, depth)):
        yield _in_all(b, block.schema, len(b))
    open_ = np.flatnonzero(beyond >= 0)
    held = {"id": p.ids.take(pa.array(open_)), "ats": block.column("ats").take(pa.array(open_)), "side": pa.array(side[open_], pa.int32()), "names": pa.array(names[open_, beyond[open_]].reshape(-1, 1).tolist(), pa.list_(pa.int64()))}
    yield _in_all(pa.RecordBatch.from_pydict(held), block.schema, len(open_))
    seen = {}
    for i, far in zip(ends, alike):
        for d in range(int(size[i]) + 1):
            inside = far >= d
            seen[int(names[i, d])] = (int(p.row_of[p.place[inside].min()]), names[i, : d + 1].tolist(), int(p.count[inside].sum()))
    rows = pa.array([r for r, _, _ in seen.values()], pa.int64())
    held = {"id": p.ids.take(rows), "ats": block.column("ats").take(rows), "names": pa.array([x for _, x, _ in seen.values()], pa.list_(pa.int64())), "n": pa.array([n for _, _, n in seen.values()], pa.int64())}
    yield _in_all(pa.RecordBatch.from_pydict(held), block.schema, len(rows))


def _in_all(batch: pa.RecordBatch, like: pa.Schema, n: int) -> pa.RecordBatch:
    """The batch with all columns that `_part` gives, null where it has none."""
    kinds = {"id": like.field("id").type, "start": pa.int32(), "end": pa.int32(), "of_doc": like.field("id").type, "ats": pa.list_(pa.int32()), "side": pa.int32(), "names": pa.list_(pa.int64()), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([batch.column(c).cast(t) if c in batch.schema.names else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def equal_runs(placed: DataFrame, part_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, start, end, of_doc): the words that an earlier place has too, around every anchor, however many rows it has:
    in parts of the rows in the order of their words, then for the groups that go on beyond a part, from its earliest places."""
    kind = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= part_rows:
                yield from _part(pa.concat_batches(held))
                held = []
        if held:
            yield from _part(pa.concat_batches(held))
        pa.default_memory_pool().release_unused()

    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("words")) for i, c in ((-1, "before"), (1, "after")))))
    order = ["key", "side", "words", "id", "ats"]  # with the place, equal words may lie in several parts
    rows = placed.select("id", "ats", "key", sides.alias("x")).select("id", "ats", "key", "x.side", "x.words").repartitionByRange(*order).sortWithinPartitions(*order)
    first = saved(rows.mapInArrow(run, f"id {kind}, start int, end int, of_doc {kind}, ats array<int>, side int, names array<bigint>, n bigint"), "rounds")
    # At most 2 (REACH + 1) groups of a part go on beyond it.
    groups = first.filter("n IS NOT NULL").groupBy(F.element_at("names", -1).alias("name")).agg(F.min(F.struct("id", F.col("ats")[0].alias("at"))).alias("home"), F.sum("n").alias("n"), F.first("names").alias("names"))
    groups = saved(groups, "rounds")
    homes = groups.filter("n > 1").select(F.col("name").alias("one"), "home")
    chain = groups.select("name", F.posexplode("names").alias("depth", "one")).join(F.broadcast(homes), "one").groupBy("name", "home").agg(F.max("depth").alias("depth"))
    chain = chain.groupBy("name").agg(F.collect_list(F.struct("home", "depth")).alias("homes"))
    rest = first.filter("side IS NOT NULL").withColumn("name", F.col("names")[0]).join(F.broadcast(chain), "name").select("id", "ats", "side", F.explode("homes").alias("x"))
    rest = rest.select("id", "ats", F.col("x.home.id").alias("of_doc"), F.col("x.home.at").alias("of_at"), F.expr("id <=> x.home.id").alias("own"), F.expr("IF(side < 0, x.depth, 0)").alias("left"), F.expr("IF(side > 0, x.depth, 0)").alias("right"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat, count = batch.column("ats").flatten().to_numpy().astype(np.int64), pa.compute.list_value_length(batch.column("ats")).to_numpy().astype(np.int64)
                own, *numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "of_at", "left", "right"))
                yield from _cut(batch.column("id"), batch.column("of_doc"), flat, np.cumsum(count) - count, count, own, *numbers)

    return saved(rest.mapInArrow(cut, f"id {kind}, start int, end int, of_doc {kind}"), "equal").union(first.filter("end IS NOT NULL").select("id", "start", "end", "of_doc"))


def _signed(docs: DataFrame, sieve, id_col: str, text_col: str) -> DataFrame:
    """(id, no, start, end, sig, keys) of every paragraph, with the keys that may be shared; start and end are word numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text", BUDGET):
                w = W.words(texts, W.LOWER)
                starts, ends = paragraphs(w)
                if not len(starts):
                    continue
                doc = np.searchsorted(w.first, starts, side="right") - 1
                base = w.first[doc]
                no = np.arange(len(doc)) - np.searchsorted(doc, doc)
                bands = _bands(w, starts, ends)
                keep = sieve.value.passes(bands)
                offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[keep]))
                ids = batch.column("id").slice(at, end - at).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(starts - base, pa.int32()), pa.array(ends - base, pa.int32()), pa.array(_names(w, starts, ends)), keys], names=["id", "no", "start", "end", "sig", "keys"])
        pa.default_memory_pool().release_unused()

    return saved(rows.mapInArrow(run, f"id {kind}, no int, start int, end int, sig bigint, keys array<bigint>"), "paragraphs")


def clusters(docs: DataFrame, signed: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sig, root): the component of every paragraph that has a near copy."""
    members = members_of(signed, shared)
    wanted = signed.join(members.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id"))
    sets = saved(fetch(docs, wanted, _sets, id_col, text_col), "sets")
    return components(links(members, sets, PERCENT)).withColumnRenamed("node", "sig")


def _shared(keyed: DataFrame) -> DataFrame:
    """`shared_keys`, with the number of rows that have each."""
    counted = keyed.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("n"))
    return saved(counted.filter("lo < hi").select("key", "lo", "n"), "shared")


def _ordered(kind: T.DataType) -> bool:
    """Whether Arrow puts ids of this type in Spark's order."""
    return isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)) or kind == T.StringType()


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with numbers in the order of their ids instead of these, and (no, doc) of each."""
    ids = docs.select(F.col(id_col).alias("doc")).distinct().orderBy("doc").select("doc", F.monotonically_increasing_id().alias("no"))
    ids = saved(ids, "ids")
    rows = docs.join(ids, docs[id_col] == ids["doc"]).select(F.struct(F.col("no").alias("id"), F.col("doc.h").alias("h")).alias(id_col), text_col)
    return rows, ids.select("no", "doc")


def _named(equal: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `grown` with the ids that the numbers stand for."""
    for c in ("id", "of_doc"):
        equal = equal.withColumn("no", F.col(f"{c}.id")).drop(c).join(ids.withColumnRenamed("doc", c), "no").drop("no")
    return equal.select("id", "start", "end", "of_doc")


@finished("spans")
def _spans(docs: DataFrame, min_span: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, end, n_words, of_docs) as in `spans`, with the rows' keys instead of ids."""
    docs, id_col, text_col = keyed(docs, id_col, text_col), "_doc", "_text"
    shared = _shared(_keyed(docs, text_col, id_col))
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(shared))
    swept(docs.sparkSession)
    hot = np.array([r["key"] for r in shared.filter(F.col("n") > HOT).select("key").collect()], np.int64)
    order, ids = (docs, None) if _ordered(docs.schema[id_col].dataType["id"].dataType) else _numbered(docs, id_col, text_col)
    equal = [saved(grown(_placed(order, sieve, id_col, text_col, hot)), "equal")]
    swept(docs.sparkSession)
    if len(hot):  # places that a text repeats are one row: most of these have few
        placed = saved(_placed(order, sieve, id_col, text_col, hot, only_hot=True), "anchors")
        large = F.broadcast(saved(placed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "large"))
        equal.append(saved(grown(placed.join(large, "key", "left_anti").select(placed.columns)), "equal"))
        if large.head(1):
            equal.append(equal_runs(placed.join(large, "key", "left_semi").select(placed.columns)))
        dropped(placed)  # what comes of it is written
        swept(docs.sparkSession)
    if ids is not None:
        equal = [_named(x, ids) for x in equal]
    signed = _signed(docs, sieve, id_col, text_col)
    shared = shared.select("key", "lo")
    roots = clusters(docs, signed, shared, id_col, text_col)
    swept(docs.sparkSession)
    # Of a paragraph that stands once and has no near copy nothing goes.
    often = signed.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig").union(roots.select("sig")).distinct()
    signed = saved(signed.select("id", "no", "start", "end", "sig").join(often, "sig", "left_semi"), "copies")
    where = signed.groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rooted = where.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = rooted.groupBy("root").agg(F.min("id").alias("of_doc"), F.sum("n").alias("n")).filter("n > 1")
    known = rooted.select("sig", "root").join(first, "root").select("sig", "root", "of_doc")
    copies = signed.join(known, "sig")
    # The earliest paragraph of the earliest document stays.
    home = copies.filter("id = of_doc").groupBy("root").agg(F.min("no").alias("home"))
    copies = copies.join(home, "root").filter("NOT (id = of_doc AND no = home)")
    every = copies.select("id", "start", "end", "of_doc")
    for more in equal:
        every = every.union(more)
    place = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(place.rowsBetween(Window.unboundedPreceding, 0))
    merged = every.withColumn("reach", reach).withColumn("run", run).groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("of_doc")).alias("of_docs"))
    out = merged.withColumn("n_words", F.col("end") - F.col("start")).filter(F.col("n_words") >= min_span)
    return out.select(F.col("id").alias("doc"), "start", "end", "n_words", "of_docs")


def spans(docs: DataFrame, min_span: int = MIN_SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, of_docs): every span to remove, as word numbers, with the
    ids of the documents that it copies."""
    out = _spans(docs, min_span, id_col, text_col)
    return out.select(F.col("doc.id").alias(id_col), "start", "end", "n_words", F.array_sort(F.array_distinct("of_docs.id")).alias("of_docs"))


def clean(docs: DataFrame, min_span: int = MIN_SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the spans cut out of the text; other columns as they are."""
    key, own, cuts = free(docs, "_key", "_own", "_cut")
    cut = _spans(docs, min_span, id_col, text_col).groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))

    @F.arrow_udf("string")
    def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(text.cast(pa.binary()).to_pylist(), cuts.to_pylist()):
            if t is not None and spans:
                w = W.words([t], W.LOWER)
                for s in sorted(spans, key=lambda s: -s["start"]):
                    t = t[: w.starts[s["start"]]] + t[w.ends[s["end"] - 1] :]
            out.append(t)
        return pa.array([x if x is None else x.decode() for x in out], pa.string())

    rows = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    joined = rows.join(cut, F.col(own) == F.col(key), "left")
    return joined.withColumn(text_col, without(F.col(text_col), F.col(cuts))).select(docs.columns)
