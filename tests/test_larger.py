"""What shows only on tables larger than the given ones: ids that come round again, and work that must grow as its input does."""

from datetime import timedelta

import numpy as np
from conftest import SF
from oracle import answer, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.operators import postings, retrieval, similarity
from lodestar.plans import catalog
from lodestar.streaming import stages


def repeated(spark, folder, table, key, times, shift):
    """A folder of `table`, `times` over with shifted keys."""
    own = spark.read.parquet(f"{SF}/{table}.parquet")
    copies = own.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    out = copies.withColumn(key, (F.col(key) + F.col("_c") * shift).cast(own.schema[key].dataType)).drop("_c")
    out.toPandas().to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(folder)


def test_a_job_runs_a_stage_again(spark, tmp_path):
    """Ids 900,000 apart are the same stage of the same job."""
    folder = repeated(spark, tmp_path, "events", "event_id", 2, 900_000)
    got, want = catalog.QUERIES["B12_stage_durations"](spark, folder).toPandas(), answer(catalog.ORACLES["B12_stage_durations"], folder)
    assert rows(got) == rows(want)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_hits_are_told_in_the_scan(spark):
    """All hits of AND queries: nothing is shuffled by chunk and term, or by query."""
    chunks = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, None)], "chunk_id bigint, text string")
    queries = spark.createDataFrame([(7, "a b"), (8, "a"), (9, "")], "query_id bigint, text string")
    hits = retrieval.sparse(chunks, queries, None, mode="and")
    assert "Exchange" not in planned(hits)
    assert sorted(map(tuple, hits.collect())) == [(7, 1, 2), (8, 1, 1), (8, 2, 2)]


def test_the_index_shuffles_rows_of_terms_only(spark, tmp_path):
    """A task writes what it has read; a search deals rows of asked terms by block, and no (query, id, term)."""
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("a b "), F.col("id") % 7).alias("text")).repartition(1)
    postings.append(chunks, str(tmp_path), buckets=4, parts=8)
    assert all(len(list(bucket.glob("*.parquet"))) == 1 for bucket in tmp_path.glob("bucket=*"))
    queries = spark.createDataFrame([(7, "a 3"), (8, "b 1 2")], "query_id bigint, text string")
    for mode in ("or", "and"):
        hits = postings.search(str(tmp_path), queries, 3, mode=mode, buckets=4)
        assert "Expand" not in planned(hits) and "hashpartitioning(block" in planned(hits)
    assert "hashpartitioning(query_id#" not in planned(postings._per_block(str(tmp_path), postings._asked(queries), "bigint", 4))
    assert [r["chunk_id"] for r in postings.search(str(tmp_path), queries, 3, buckets=4).filter("query_id = 7").orderBy("rank").collect()] == [3, 10, 17]


class _State:
    """A state and its timers that count their calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def _called(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._called(self.value is not None)

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(self._called(at))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(self._called(at))


def test_a_batch_reads_and_writes_the_state_once():
    state, stage = _State(), stages.Stages(timedelta(milliseconds=100))
    stage.init(state)
    row = lambda i, ms, status: Row(log_id=i, ms=ms, status=status)
    done = lambda batch: [tuple(r)[2:] for r in stage.handleInputRows((1, "load"), iter(batch), None)]
    assert done([row(i, 10 * i, "succeeded" if i % 2 else "started") for i in range(1001)]) == [(i, "succeeded", 10) for i in range(0, 1000, 2)]
    assert state.calls <= 5 and state.value == (1000, 10_000) and state.timers == {10_100}
    assert done([row(2001, 10_050, "started")]) == [(1000, "restarted", 50)] and state.timers == {10_150}
    assert done([row(2003, 10_300, "failed"), row(2002, 10_250, "started")]) == [(2001, "failed", 100), (2002, "failed", 50)]
    assert state.value is None and not state.timers and done([row(2004, 10_400, "failed")]) == []


def test_a_row_travels_once_to_each_group_of_cells(spark, monkeypatch):
    """More visits, as with more cells, are not more rows to shuffle: at most one for each of the groups, and the parts of the hosts."""
    monkeypatch.setattr(similarity, "CELL", 10)
    rng = np.random.default_rng(4)
    rows = [(i, "t", rng.standard_normal(8).tolist()) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, t string, vec array<double>")
    seen, scored = [], similarity._visited

    def counted(met, pivots, kind, at_least):
        (p, reach, blocks), n = pivots["8/t"], len(rows)
        base, size, parts = similarity._dealt(p, reach, blocks, n)[3:] if hasattr(similarity, "_dealt") else (None, 1, 1)
        groups = -(-int(blocks.sum()) // size)
        seen.append((groups, parts, len(p)))
        return scored(met, pivots, kind, at_least)

    monkeypatch.setattr(similarity, "_visited", counted)
    got = {r["id"]: r["of"] for r in similarity.nearest(d, "t").collect()}
    groups, parts, cells = seen[0]
    assert groups <= similarity.SPREAD < cells / 2 and parts <= similarity.SPREAD
    x = np.array([v for _, _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 9) - 2 * np.eye(len(x))
    assert got == dict(enumerate(sim.argmax(axis=1).tolist()))
