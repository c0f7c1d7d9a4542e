"""The nearest other row of every row, by exact cosine, without meeting all rows.

Unit vectors have a metric: their distance is sqrt(2 - 2 cosine).  A tenant's vectors are
dealt to the cell of their nearest pivot, pivots being a sample of the tenant's own rows,
so that dense places have many cells and a cell holds CELL rows or so.  A row first meets
the rows of its own block.  What it found there, or the least cosine that counts, is a
radius, and it then visits only cells that can hold something nearer: those whose border
with its own cell lies within the radius, and whose own radius reaches that far.  Cells
lie together in groups that a task can hold, and a row is shuffled once for each group
in which it visits any cell, so the shuffle hardly grows with the number of visits.

Equal vectors are one row until the end, so any number of copies costs one search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import saved

#: Rows of a cell, about, and of a block within it at most twice as many.
CELL = 2000
#: Bytes of all pivots, which are broadcast; with more rows than they give cells for, cells grow and are cut in blocks.
PIVOT_BYTES = 32 << 20
#: Bytes of the vectors of a group of blocks, at most; SPREAD groups or more where a tenant has as many blocks.
GROUP_BYTES = 128 << 20
SPREAD = 8
#: Visitors that a task scores against one group; more are dealt to further tasks, as are those of
#: tenants of over 8 * CELL rows, to SPREAD.
VISITORS = 200_000
#: Kept for callers: how many tasks a group needs follows from the tenant's rows.
MAX_BUSY = 200_000
#: Parts that the copies of one vector are dealt to.
SALTS = 64
#: Cosines are rounded to 9 places; distances carry this much more than that can hide.
SLACK = 1e-6
_KEY = ["t", "h1", "h2"]


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.stack(lists.to_numpy(zero_copy_only=False))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _radius(sim: np.ndarray, at_least: float) -> np.ndarray:
    """How far something as good as `sim`, and of `at_least`, may be."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(sim, at_least))) + SLACK + 1e-4


def _best(x: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and cosine of the nearest of `others`, which ascend by id, for each row of x; equal ids do not count."""
    place, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for at in range(0, len(x), 500):
        sim = np.round(x[at : at + 500] @ others.T, 9)
        sim[ids[at : at + 500][:, None] == other_ids[None, :]] = -np.inf
        place[at : at + 500] = sim.argmax(axis=1)
        best[at : at + 500] = sim[np.arange(len(sim)), place[at : at + 500]]
    return place, best


def nearest(rows: DataFrame, tenant: str, id_col: str = "doc_id", vec_col: str = "vec", at_least: float = -1.0) -> DataFrame:
    """(id, of, sim): each row's most similar other row of its tenant, ties by the smaller id, where one has a cosine of `at_least`.

    Ids are unique within a tenant.  Rows without a tenant, an id or a vector, and zero
    vectors, are like nothing; vectors of unequal lengths do not meet.
    """
    spark = rows.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    base = rows.filter(F.col(tenant).isNotNull() & F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.concat_ws("/", F.size(vec_col), F.col(tenant).cast("string")).alias("t"), F.col(id_col).alias("id"), vec.alias("vec"))
    base = base.filter(F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    distinct = saved(base.groupBy(*_KEY).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    kind = distinct.schema["id"].dataType.simpleString()

    placed, pivots = _placed(distinct, kind)
    met = saved(placed.groupBy("t", "cell", "block").applyInArrow(_meet, f"t string, cell int, block int, h1 bigint, h2 bigint, id {kind}, n bigint, vec array<double>, of {kind}, sim double"), "met")
    best = met.filter(F.col("sim") >= at_least).select(*_KEY, "id", "n", "of", "sim")
    if pivots:
        best = best.unionByName(_visited(met, pivots, kind, at_least)).groupBy(*_KEY, "id", "n").agg(F.min_by(F.struct("of", "sim"), F.struct(-F.col("sim"), "of")).alias("x")).select(*_KEY, "id", "n", "x.of", "x.sim")
    if not distinct.filter("n > 1").limit(1).count():
        return best.select("id", "of", "sim")
    return best.filter("n = 1").select("id", "of", "sim").unionByName(_copies(base, distinct, best, at_least))


def _placed(distinct: DataFrame, kind: str) -> tuple[DataFrame, dict]:
    """Rows with their cell and block, and for each tenant of more than one cell its pivots,
    the cells' radii and how many blocks each has."""
    spark = distinct.sparkSession
    large = distinct.groupBy("t").agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("d")).filter(F.col("rows") > CELL)
    need = large.agg(F.sum(F.col("rows") / CELL * F.col("d") * 8).alias("bytes")).first()["bytes"]
    if not need:
        return distinct.select("*", F.lit(0).alias("cell"), F.lit(0).alias("block")), {}
    share = min(1.0, PIVOT_BYTES / need) / CELL
    drawn = distinct.filter((F.pmod("h2", F.lit(1 << 40)) / float(1 << 40)) < share).join(large.select("t"), "t", "left_semi").select("t", "vec").toArrow()
    pivots: dict = {}
    for t in set(drawn.column("t").to_pylist()):
        pivots[t] = _unit(drawn.filter(pa.compute.equal(drawn.column("t"), t)).column("vec").combine_chunks())
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            tenants = batch.column("t").dictionary_encode()
            code = tenants.indices.to_numpy()
            for k, t in enumerate(tenants.dictionary.to_pylist()):
                if (p := shared.value.get(t)) is not None:
                    at = np.flatnonzero(code == k)
                    step = max(1, (4 << 20) // len(p))
                    for part in (at[i : i + step] for i in range(0, len(at), step)):
                        dot = _unit(batch.column("vec").take(pa.array(part))) @ p.T
                        cell[part] = dot.argmax(axis=1)
                        away[part] = np.sqrt(np.maximum(0.0, 2 - 2 * dot.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    cells = saved(distinct.mapInArrow(place, f"t string, h1 bigint, h2 bigint, id {kind}, n bigint, vec array<double>, cell int, away double"), "cells")
    told = cells.join(large.select("t"), "t", "left_semi").groupBy("t", "cell").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).toArrow()
    out: dict = {t: (p, np.zeros(len(p)), np.zeros(len(p), np.int64)) for t, p in pivots.items()}
    for t, cell, n, radius in zip(*(told.column(c).to_pylist() for c in ("t", "cell", "rows", "radius"))):
        if t in out:
            out[t][1][cell], out[t][2][cell] = radius, -(-n // (2 * CELL))
    # A tenant without a pivot is one cell, and tenants and cells alike are cut in blocks of bounded size.
    sizes = cells.groupBy("t", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("blocks")).filter("blocks > 1")
    for t, cell, blocks in sizes.collect():
        if t not in out:
            d = len(distinct.filter(F.col("t") == t).first()["vec"])
            out[t] = (np.eye(1, d), np.full(1, 2.0), np.full(1, blocks))
    counts = spark.sparkContext.broadcast({t: v[2] for t, v in out.items()})

    @F.arrow_udf("int")
    def blocks_of(t: pa.Array, cell: pa.Array) -> pa.Array:
        return pa.array([int(b[c]) if (b := counts.value.get(x)) is not None else 1 for x, c in zip(t.to_pylist(), cell.to_pylist())], pa.int32())

    return cells.drop("away").withColumn("block", F.pmod("h1", blocks_of("t", "cell")).cast("int")), out


def _meet(block: pa.Table) -> pa.Table:
    """The nearest of each row within its block; null and -1 without another row."""
    block = block.take(pa.compute.sort_indices(block.column("id")))
    x, ids = _unit(block.column("vec").combine_chunks()), block.column("id").to_numpy()
    place, sim = _best(x, ids, x, ids)
    none = ~np.isfinite(sim)
    of = block.column("id").take(pa.array(place, mask=none))
    names = ["t", "cell", "block", "h1", "h2", "id", "n", "vec"]
    return pa.table([*(block.column(c) for c in names), of, pa.array(np.where(none, -2.0, sim))], names=[*names, "of", "sim"])


def visits(x: np.ndarray, home: np.ndarray, radius: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells, its own among them, that can hold something within a row's radius.

    The border between its own cell and another lies (x . own - x . other) / |own - other| away."""
    dot = x @ pivots.T
    own = dot[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots[home] @ pivots.T))
    border = (own[:, None] - dot) / np.maximum(apart, 1e-12)
    near = (border <= radius[:, None]) | (apart <= 1e-9)
    near &= np.sqrt(np.maximum(0.0, 2 - 2 * dot)) <= reach + radius[:, None] + SLACK
    near[np.arange(len(x)), home] = True
    return np.nonzero(near)


def _dealt(pivots: np.ndarray, reach: np.ndarray, blocks: np.ndarray, rows: int) -> tuple:
    """A tenant's pivots, reach and blocks of cells, and: the first slot of each cell, a slot being a block; slots of a group; parts of a group's visitors."""
    base = np.cumsum(blocks) - blocks
    size = min(max(1, GROUP_BYTES // (2 * CELL * 8 * pivots.shape[1])), max(1, -(-int(blocks.sum()) // SPREAD)))
    return pivots, reach, blocks, base, size, max(-(-rows // VISITORS), min(SPREAD, -(-rows // (8 * CELL))), 1)


def _visited(met: DataFrame, pivots: dict, kind: str, at_least: float) -> DataFrame:
    """(key, id, n, of, sim): what rows find in the blocks that they visit."""
    counts = {r["t"]: r["rows"] for r in met.groupBy("t").agg(F.count("*").alias("rows")).filter(F.col("rows") > CELL).collect()}
    shared = met.sparkSession.sparkContext.broadcast({t: _dealt(*p, counts.get(t, 1)) for t, p in pivots.items()})
    names = ["h1", "h2", "id", "n", "vec"]
    place = ["t", "grp", "part", "side"]

    def rows_of(rows: pa.RecordBatch, row: np.ndarray, grp: np.ndarray, part: np.ndarray, side: int, first: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(row), 10_000):
            at, some = slice(i, i + 10_000), rows.take(pa.array(row[i : i + 10_000]))
            bounds = np.r_[first[at], first[i + some.num_rows] if i + some.num_rows < len(first) else len(slots)]
            lists = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(slots[bounds[0] : bounds[-1]], pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("t"), pa.array(grp[at], pa.int32()), pa.array(part[at], pa.int32()), pa.array(np.full(some.num_rows, side, np.int32)), lists, *(some.column(c) for c in names)], names=[*place, "slots", *names])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tenants = batch.column("t").dictionary_encode()
            code = tenants.indices.to_numpy()
            for k, t in enumerate(tenants.dictionary.to_pylist()):
                if t not in shared.value or shared.value[t][2].sum() < 2:
                    continue
                p, reach, blocks, base, size, parts = shared.value[t]
                at = np.flatnonzero(code == k)
                step = max(1, (1 << 20) // len(p))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    rows = batch.take(pa.array(some))
                    home, own = rows.column("cell").to_numpy(), rows.column("block").to_numpy()
                    mine = base[home] + own
                    host = np.repeat(np.arange(len(mine)), parts)
                    yield from rows_of(rows, host, mine[host] // size, np.tile(np.arange(parts), len(mine)), 0, np.arange(len(host)), mine[host])
                    row, cell = visits(_unit(rows.column("vec")), home, _radius(rows.column("sim").to_numpy(), at_least), p, reach)
                    each = blocks[cell]
                    row, slot = np.repeat(row, each), np.repeat(base[cell] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    away = slot != mine[row]
                    row, slot = row[away], slot[away]
                    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(slot // size) != 0)][: len(row)])
                    yield from rows_of(rows, row[first], slot[first] // size, rows.column("h1").to_numpy()[row[first]] % parts, 1, first, slot)

    both = met.select("t", "cell", "block", *names, "sim").mapInArrow(go, f"t string, grp int, part int, side int, slots array<int>, h1 bigint, h2 bigint, id {kind}, n bigint, vec array<double>")
    return both.repartition(*place[:3]).sortWithinPartitions(*place).mapInArrow(_score, f"t string, h1 bigint, h2 bigint, id {kind}, n bigint, of {kind}, sim double").filter(F.col("sim") >= at_least)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their group, hosts before visitors: hosts are held, visitors pass by the blocks that they visit."""
    key, held, hosts = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("t", "grp", "part", "side")]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in at], axis=0)) + 1
        for a, b in zip([0, *edge], [*edge, batch.num_rows]):
            run = batch.slice(a, b - a)
            now = tuple(run.column(c)[0].as_py() for c in ("t", "grp", "part"))
            if now != key:
                key, held, hosts = now, [], None
            if run.column("side")[0].as_py() == 0:
                held.append(run.select(["id", "vec", "slots"]))
                continue
            if hosts is None:
                hosts, held = _held(held) if held else ({}, []), []  # a block of a cell can be empty
            blocks, ids = hosts
            x, own = _unit(run.column("vec")), run.column("id").to_numpy(zero_copy_only=False)
            lists = run.column("slots")
            row, slot = np.repeat(np.arange(len(x)), pa.compute.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
            place, best = np.full(len(x), len(ids)), np.full(len(x), -np.inf)
            for s in np.unique(slot):
                if s not in blocks:
                    continue
                some, (spots, others, other_ids) = row[slot == s], blocks[s]
                where, sim = _best(x[some], own[some], others, other_ids)
                where = spots[where]
                better = np.isfinite(sim) & ((sim > best[some]) | ((sim == best[some]) & (where < place[some])))
                place[some[better]], best[some[better]] = where[better], sim[better]
            found = np.flatnonzero(np.isfinite(best))
            if len(found):
                some = run.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("t", "h1", "h2", "id", "n")), ids.take(pa.array(place[found])), pa.array(best[found])], names=["t", "h1", "h2", "id", "n", "of", "sim"])


def _held(batches: list[pa.RecordBatch]) -> tuple[dict, pa.Array]:
    """By slot: the places in order of the id, unit vectors and ids of a group's rows; and all ids in their order."""
    table = pa.Table.from_batches(batches)
    table = table.take(pa.compute.sort_indices(table.column("id"))).combine_chunks()
    x, ids, slot = _unit(table.column("vec").combine_chunks()), table.column("id").to_numpy(), table.column("slots").combine_chunks().flatten().to_numpy()
    spots = {s: np.flatnonzero(slot == s) for s in np.unique(slot)}
    column = table.column("id").combine_chunks()
    return {s: (at, x[at], ids[at]) for s, at in spots.items()}, column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _copies(base: DataFrame, distinct: DataFrame, best: DataFrame, at_least: float) -> DataFrame:
    """(id, of, sim) of rows whose vector occurs more than once: the smallest other copy, or
    a smaller id at the same cosine.  Copies of one vector are joined in SALTS parts."""
    if at_least > 1.0:
        return base.select("id", F.col("id").alias("of"), F.lit(0.0).alias("sim")).limit(0)
    groups = distinct.filter("n > 1").select(*_KEY, F.col("id").alias("first"))
    members = base.select(*_KEY, "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    spread = lambda known: members.join(members.select(*_KEY, "salt").distinct().join(known, _KEY), [*_KEY, "salt"])
    second = spread(groups).filter("id <> first").groupBy(*_KEY).agg(F.min("id").alias("second"))
    known = groups.join(second, _KEY, "left").join(best.filter("n > 1").select(*_KEY, "of", "sim"), _KEY, "left")
    copy = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    other = (F.col("sim") >= 1) & (F.col("of") < copy) | copy.isNull()
    found = spread(known).select("id", F.when(other, F.col("of")).otherwise(copy).alias("of"), F.when(copy.isNull(), F.col("sim")).otherwise(F.lit(1.0)).alias("sim"))
    return found.filter("of IS NOT NULL")
