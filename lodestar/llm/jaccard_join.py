"""Operator 6: an exact Jaccard self-join of word n-gram sets by prefix trees.

A text's set is its distinct `n`-word shingles (after lower-casing A-Z); with fewer
words the whole sequence is the one shingle; null and empty texts have no set and link
with nothing.  Two texts link when 100 * |intersection| >= percent * |union|.

Blocks.  A linked pair of sizes up to u differs in d(u) elements at most, so of 1.25 d
slices of the hash range a quarter of d or more hold the same elements in both.  Every set
emits the hash of each slice's elements under its own size class and the next one.  Keys
are aggregated to their least and greatest set, with combining before the shuffle, so
copies and hot keys cost a row for each task.  Sets that share fewer keys with all others
together than a link needs with one leave there.

Trees.  The sets of a block, in the one global order of their hashes, go into a prefix
tree.  A set is matched against all members at once: partial overlaps are shared along
common prefixes, and a subtree is left when the elements that remain cannot reach the
overlap needed, or when all of it is linked to the set already.  A tree gives the edges
of a spanning forest, so a group of any size gives a row for each member and no pairs.

Two rounds.  In the first every candidate goes to one block, that of its least key
partner; large blocks are split, each part with that partner.  Their components are
found.  In the second, the keys whose members are not yet in one component go through
trees with all their members, keys of the same least member together, large blocks as all
pairs of parts.  So no link is lost.

Equal sets count once, so ties and repeated rows cost nothing more.  Shingles and sets are
told apart by 64-bit hashes.  Texts of any length are read whole; an empty table gives no
rows.  Rows that share an id, or have none, give a row each in `classes`; `one_of_each`
tells them apart by a hash of the text.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words as W
from lodestar.llm.components import components
from lodestar.llm.sieve import Sieve
from lodestar.llm.storage import finished, free, keyed, saved

SHINGLE = 3
PERCENT = 90
#: Bytes of sets in one tree.
BLOCK_BYTES = 2 << 20
#: Most candidate rows whose ids are broadcast (about 20 MB); more are joined by a shuffle.
MAX_BROADCAST = 300_000


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = W.words(texts, W.LOWER)
    at, h = w.windows(n)
    edge = np.searchsorted(at, w.first)
    out = [np.unique(h[edge[i] : edge[i + 1]]) for i in range(len(texts))]
    for i in np.flatnonzero((w.count > 0) & (w.count < n)).tolist():
        out[i] = W.window_hash([w.hashes[j : j + 1] for j in range(w.first[i], w.first[i + 1])])
    return out


def identity(x: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(W.mix(np.array([W.mix(x).sum(dtype=np.uint64) + np.uint64(len(x))])).view(np.int64)[0])


@cache
def _limits(percent: int) -> list[int]:
    """Where the size classes begin: a set's partners are in its class or a class beside it."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent + 1))
    return out


def keys(x: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """The slice keys of a set under its own size class and the next: (need, keys) of each.

    There are a quarter more slices than a linked pair can differ in, so linked sets share
    `need` keys or more under a class that both sign.
    """
    limits = _limits(percent)
    own = int(np.searchsorted(limits, len(x), side="right")) - 1
    mixed, top, out = W.mix(x), x >> np.uint64(32), []
    for scheme in (own, own + 1):
        most = limits[scheme + 1] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        if not differ:  # at this size linked sets are equal
            out.append((1, np.zeros(0, np.uint64)))
            continue
        cut = differ + 1 + (differ + 1) // 4
        piece = (top * np.uint64(cut)) >> np.uint64(32)
        size = np.bincount(piece.astype(np.int64), minlength=cut)
        full = np.flatnonzero(size > 0)
        total = np.zeros(cut, dtype=np.uint64)
        total[full] = np.add.reduceat(mixed, np.cumsum(size)[full] - size[full])
        tag = np.arange(cut, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((scheme + 1) * 0xD1342543DE82EF95 % (1 << 64)) + size.astype(np.uint64)
        signed = W.mix(W.mix(total) + tag)
        need = cut - differ - (cut - len(full))
        out.append((need, signed[full]) if need > 0 else (cut - differ, signed))  # empty slices count only where they must
    return out


_NONE = [(1, np.zeros(0, np.uint64))] * 2


def _of(texts: list[bytes | None], n: int, percent: int) -> tuple[list[np.ndarray], list[list[tuple[int, np.ndarray]]]]:
    """The sets of some texts and their keys."""
    sets = shingles(texts, n)
    return sets, [keys(x, percent) if len(x) else _NONE for x in sets]


def _keyed(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(key, sig) of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in W.chunks(batch, "_text"):
                sets, each = _of(texts, n, percent)
                sigs = np.array([identity(x) if len(x) else 0 for x in sets], dtype=np.int64)
                flat = [k for signed in each for _, k in signed]
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(flat).view(np.int64)), "sig": pa.array(np.repeat(np.repeat(sigs, 2), [len(k) for k in flat]))})

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "key bigint, sig bigint")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, lo): of (key, sig) the keys that different sets have, with the least of them."""
    return saved(keyed.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo < hi").select("key", "lo"), "shared")


def _signed(docs: DataFrame, sieve: Sieve, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, sig, need0, keys0, need1, keys1) of every row, with the keys that may
    be shared; sig is null for an empty set."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    bits = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text"):
                sets, each = _of(texts, n, percent)
                out = [batch.column("id").slice(at, end - at), pa.array([len(x) for x in sets], pa.int64()), pa.array([identity(x) if len(x) else None for x in sets], pa.int64())]
                for scheme in (0, 1):
                    kept = [k.view(np.int64) for k in (signed[scheme][1] for signed in each)]
                    kept = [k[bits.value.passes(k)] for k in kept]
                    offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                    out += [pa.array([signed[scheme][0] for signed in each], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_shingles", "sig", "need0", "keys0", "need1", "keys1"])

    return saved(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, sig bigint, need0 int, keys0 array<bigint>, need1 int, keys1 array<bigint>"), "signed")


def _strong(signed: DataFrame, shared: DataFrame, rounds: int = 2) -> DataFrame:
    """(key, lo, sig): the shared keys of the sets that share as many under one class as a link needs.

    A set left out has no link, so its keys are shared by fewer of the others, who may then
    leave too: each round counts anew.  More rounds cost time and never change the links.
    """
    each = [signed.select("sig", F.lit(s).alias("scheme"), F.col(f"need{s}").alias("need"), F.explode(f"keys{s}").alias("key")) for s in (0, 1)]
    held = saved(each[0].union(each[1]).join(shared.select("key"), "key").distinct(), "members")
    for _ in range(rounds):
        strong = held.groupBy("sig", "scheme").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("sig", "scheme")
        held = held.join(strong, ["sig", "scheme"], "left_semi")
        again = held.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo < hi").select("key", "lo")
        held = saved(held.drop("lo").join(again, "key"), "members")
    return held.select("key", "lo", "sig").distinct()


def fetch(docs: DataFrame, wanted: DataFrame, make: Callable[[list[bytes | None]], list[tuple[int, np.ndarray]]], id_col: str, text_col: str) -> DataFrame:
    """(sig, n, elements) of the wanted (sig, id); `make` gives the sets of some texts with their sigs."""
    ids = wanted.select(F.col("id").alias("_key")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    rows = docs.join(ids, docs[id_col].eqNullSafe(ids["_key"]), "left_semi").select(F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in W.chunks(batch, "_text"):
                sets = make(texts)
                yield pa.RecordBatch.from_pydict({"sig": pa.array([k for k, _ in sets], pa.int64()), "n": pa.array([len(x) for _, x in sets], pa.int64()), "elements": pa.array([x.tobytes() for _, x in sets], pa.binary())})

    found = rows.mapInArrow(run, "sig bigint, n bigint, elements binary")
    return found.join(wanted.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"])


class Tree:
    """A prefix tree of sets over a numbered alphabet; `link` finds partners of a set and then adds it.

    Elements that only one set of the block has can be in no overlap: they are not in the
    tree, but count in the sizes.  Runs of elements are bit masks, so an overlap is the
    number of bits that two masks share.
    """

    def __init__(self, percent: int):
        self.percent, self.root = percent, _Node(np.zeros(0, np.int64))
        self.sizes: list[int] = []
        self.up: list[int] = []
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def need(self, x: int, y: int) -> int:
        """The least overlap with which sets of these sizes link."""
        return -(-self.percent * (x + y) // (100 + self.percent))

    def link(self, x: np.ndarray, size: int, same_as: int | None = None) -> None:
        """x: the sorted numbers of the set's elements; size: with those outside the alphabet;
        same_as: a member known to be in the set's component already."""
        me, mask = len(self.sizes), _mask(x)
        self.sizes.append(size)
        self.up.append(me if same_as is None else self.find(same_as))
        least, most = -(-size * self.percent // 100), size * 100 // self.percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, matched, depth = stack.pop()
            if node.one is not None and node.one >= 0 and self.find(node.one) == self.find(me):
                continue
            if node.low > most or node.high < least:
                continue
            if node.mask:
                matched += (mask & node.mask).bit_count()
                depth += len(node.edge)
            if depth - matched + node.alone > node.high - self.need(size, node.high):
                continue  # too few elements are left in all of the subtree
            for j in node.ends:
                if matched >= self.need(size, self.sizes[j]) and self.find(j) != self.find(me):
                    self.edges.append((me, j))
                    self.up[self.find(j)] = self.find(me)
            stack += [(k, matched, depth) for k in node.next.values()]
        self._add(me, x, size)

    def _add(self, me: int, x: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        node.take(self, me, size, len(x))
        while at < len(x):
            first = int(x[at])
            child = node.next.get(first)
            if child is None:
                child = node.next[first] = _Node(x[at:])
                child.take(self, me, size, len(x))
                child.ends.append(me)
                return
            n = min(len(child.edge), len(x) - at)
            differ = np.flatnonzero(child.edge[:n] != x[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.edge):
                upper = _Node(child.edge[:same])
                upper.low, upper.high, upper.alone, upper.one = child.low, child.high, child.alone, child.one
                child.edge = child.edge[same:]
                child.mask = _mask(child.edge)
                upper.next[int(child.edge[0])] = child
                node.next[first] = child = upper
            child.take(self, me, size, len(x))
            node, at = child, at + same
        node.ends.append(me)


def _mask(x: np.ndarray) -> int:
    """The numbers as bits."""
    if not len(x):
        return 0
    base = int(x[0])
    bits = np.zeros(int(x[-1]) - base + 1, dtype=np.uint8)
    bits[x - base] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") << base


class _Node:
    """A run of elements, what follows it, the sets that end here, and of the sets below the
    sizes, the fewest elements outside the alphabet, and a member if all are linked."""

    __slots__ = ("edge", "mask", "next", "ends", "low", "high", "alone", "one")

    def __init__(self, edge: np.ndarray):
        self.edge, self.mask, self.next, self.ends = edge, _mask(edge), {}, []
        self.low, self.high, self.alone, self.one = 1 << 60, 0, 1 << 60, -1

    def take(self, tree: Tree, me: int, size: int, inside: int) -> None:
        self.low, self.high, self.alone = min(self.low, size), max(self.high, size), min(self.alone, size - inside)
        if self.one == -1:
            self.one = me
        elif self.one is not None and tree.find(self.one) != tree.find(me):
            self.one = None  # more than one component below


def forest(sets: list[np.ndarray], roots: list, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sorted sets, enough to connect all that are linked; sets of one root are connected already."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    alphabet, at, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    tree, seen, first = Tree(percent), {}, 0
    for i, x in enumerate(sets):
        own = at[first : first + len(x)]
        first += len(x)
        tree.link(number[own[count[own] > 1]], len(x), seen.get(roots[i]))
        seen.setdefault(roots[i], i)
    return tree.edges


def _forest(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found in each block of (b1, b2, b3, sig, root, elements).

    The blocks of a partition follow one another in batches, so a small one costs no call of its own."""

    def join(block: list[tuple]) -> list[tuple[int, int]]:
        block.sort(key=lambda r: (r[1], len(r[2]), r[0]))
        edges = forest([np.frombuffer(x, np.uint64) for _, _, x in block], [root for _, root, _ in block], percent)
        return [(block[i][0], block[j][0]) for i, j in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, found = None, [], []
        for batch in batches:
            for *at, sig, root, elements in zip(*(batch.column(c).to_pylist() for c in ("b1", "b2", "b3", "sig", "root", "elements"))):
                if at != name:
                    found += join(held) if len(held) > 1 else []
                    name, held = at, []
                held.append((sig, root, elements))
            if found:
                yield _edges(found)
                found = []
        yield _edges(join(held) if len(held) > 1 else [])

    place = ("b1", "b2", "b3")
    return blocks.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a bigint, b bigint")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def members_of(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, lo, sig): every set that has a shared key."""
    return saved(signed.select("sig", F.explode("keys").alias("key")).join(shared, "key").select("key", "lo", "sig").distinct(), "members")


def links(members: DataFrame, sets: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links between different sets that share a key, enough to connect all that are linked."""
    # One block for each candidate.
    first = members.groupBy("sig").agg(F.min("lo").alias("hub"))
    sized = first.join(sets.select("sig", "n"), "sig")
    parts = sized.groupBy("hub").agg(F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("parts"))
    spread = sized.join(parts, "hub").select("hub", "sig", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part")).filter("sig <> hub")
    hubs = parts.select("hub", F.col("hub").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = spread.union(hubs).join(sets, "sig").select(F.col("hub").alias("b1"), F.col("part").alias("b2"), F.lit(0).alias("b3"), "sig", F.col("sig").alias("root"), "elements")
    found = saved(_forest(one, percent), "links")
    known = components(found)

    # Keys whose members are still apart, put together by their least member: a set goes
    # there once, however many keys it shares with that member.
    rooted = members.select("key", "sig").join(known.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("root", "sig").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("sig").alias("owner")).filter("lo < hi").select("key", "owner")
    left = rooted.join(apart, "key").select("owner", "sig", "root").distinct()
    left = saved(left.join(sets.select("sig", "n"), "sig"), "apart")
    parts = left.groupBy("owner").agg(F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    pairs = left.join(parts, "owner").withColumn("own", own).select(F.col("owner").alias("key"), "sig", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    two = pairs.join(sets, "sig").select(F.col("key").alias("b1"), F.least("own", "other").alias("b2"), F.greatest("own", "other").alias("b3"), "sig", "root", "elements")
    return found.union(saved(_forest(two, percent), "links"))


def _rooted(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows of `keyed`: (id, n_shingles, sig) of each, and (sig, root) of every set."""
    shared = shared_keys(_keyed(docs, n, percent, "_text"))
    signed = _signed(docs, Sieve(shared), n, percent, "_doc", "_text")
    members = _strong(signed, shared)
    wanted = signed.groupBy("sig").agg(F.min("id").alias("id")).join(members.select("sig").distinct(), "sig", "left_semi")
    sets = saved(fetch(docs, wanted, lambda texts: [(identity(x), x) for x in shingles(texts, n) if len(x)], "_doc", "_text"), "sets")
    roots = components(links(members, sets, percent)).withColumnRenamed("node", "sig")
    every = signed.filter("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct(F.col("id.id").isNull().alias("none"), "id")).alias("x")).select("sig", F.col("x.id").alias("least")).join(roots, "sig", "left")
    every = every.select("sig", F.coalesce("root", "sig").alias("root"), "least")
    least = every.groupBy("root").agg(F.min(F.struct(F.col("least.id").isNull().alias("none"), "least")).alias("x"))
    return signed.select("id", "n_shingles", "sig"), saved(every.select("sig", "root").join(least, "root").select("sig", F.col("x.least").alias("least")), "classes")


@finished("classes")
def classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links reach, of every row."""
    rows, least = _rooted(keyed(docs, id_col, text_col), n, percent)
    out = rows.join(least, "sig", "left")
    return out.select(F.col("id.id").alias(id_col), "n_shingles", F.when(F.col("least").isNull(), F.col("id.id")).otherwise(F.col("least.id")).alias("component_id"))


@finished("copies")
def _copies(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, stays): rows that go, and of the rows that stay those which stand there more than once."""
    rows, least = _rooted(keyed(docs, id_col, text_col), n, percent)
    each = rows.filter("sig IS NOT NULL").groupBy("id", "sig").agg(F.count("*").alias("n")).join(least, "sig")
    stays = F.col("id") == F.col("least")
    return each.filter(~stays | (F.col("n") > 1)).select("id", stays.alias("stays"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class: that of the smallest id, and of the smallest hash of
    its text where ids are equal or null.  Texts without words are in no class and all stay."""
    key, own, stays = free(docs, "_key", "_own", "_stays")
    found = _copies(docs, n, percent, id_col, text_col).select(F.col("id").alias(key), F.col("stays").alias(stays))
    rows = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    out = rows.join(found, F.col(own) == F.col(key), "left")
    single = out.filter(F.col(stays).isNull()).select(docs.columns)
    if found.filter(stays).head(1):
        return single.unionByName(out.filter(stays).dropDuplicates([own]).select(docs.columns))
    return single
