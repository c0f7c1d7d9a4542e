"""Dense, sparse and hybrid retrieval for many queries at once, and what follows it.

Ranks start at 1 and every order ends in the chunk's id.  Queries are a table; nothing here
loops over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Bytes of query vectors in one broadcast block.
QUERY_BYTES = 32 << 20
#: Most (query, term) rows that are broadcast: about 50 MB.
MAX_ASKED = 1_000_000
#: Rows that a task scores at once against 200 queries.
ROWS = 2000
# One-letter particles that end a Korean word, and the trailing signs dropped with them.
PARTICLES = "는은가을를도만에의"
SIGNS = "?!.,;:"


def cosine(a: str | Column, b: str | Column, null_policy: float | None = None) -> Column:
    """Cosine in double precision; for a zero vector or unequal lengths the policy's value."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(null_policy))


class _Top:
    """The k best (greatest score, least id) of each of n queries so far, in a task."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray, above: float = -np.inf, of: np.ndarray | None = None) -> None:
        """scores: a row for each id, a column for each query, or for each of `of`; only those greater than `above` count."""
        floor = self.floor if of is None else self.floor[of]
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, column = np.nonzero((scores >= floor) & (scores > above))
        query, score = np.concatenate([self.query, column if of is None else of[column]]), np.concatenate([self.score, scores[row, column]])
        every = ids[row] if self.id is None else np.concatenate([self.id, ids[row]])
        order = np.lexsort((every, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[order][keep], every[order][keep]
        last = place[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last]

    def batch(self, names: pa.Array, ids: pa.DataType, kind: pa.DataType, score: str) -> pa.RecordBatch:
        found = pa.array([] if self.id is None else self.id, ids)
        return pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), found, pa.array(self.score).cast(kind)], names=["query_id", "id", score])


def dense(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, id, sim, rank): the k nearest by exact cosine, of every query.

    The queries' vectors are broadcast, in as many blocks as QUERY_BYTES asks for; each
    task multiplies blocks of rows and keeps its own k best for each query, so k rows for
    each query and task are shuffled.  Similarities are rounded to 9 places before they
    are ranked, so that the order does not hang on the last bit.
    """
    spark = chunks.sparkSession
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-(sizes["n"] or 0) * (sizes["d"] or 1) * 8 // QUERY_BYTES))
    rows = chunks.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, sim double"
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vecs = np.stack(part.column("vec").to_numpy())
        shared = spark.sparkContext.broadcast((part.column("query_id").combine_chunks(), vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            top, kind = _Top(len(names), k), None
            for batch in batches:
                kind = batch.column("id").type
                for at in range(0, batch.num_rows, ROWS):
                    block = batch.slice(at, ROWS)
                    x = np.stack(block.column("vec").to_numpy(zero_copy_only=False))
                    size = np.linalg.norm(x, axis=1)
                    ids = block.column("id").to_numpy(zero_copy_only=False)[size > 0]
                    top.add(np.round((x[size > 0] / size[size > 0][:, None]) @ q.T, 9), ids)
            if kind is not None:
                yield top.batch(names, kind, pa.float64(), "sim")

        local = rows.mapInArrow(best, kinds)
        found = local if found is None else found.unionByName(local)
    if found is None:
        return spark.createDataFrame([], f"query_id bigint, {id_col} bigint, sim double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


def above(rows: DataFrame, anchors: DataFrame, at_least: float, by: str, id_col: str = "doc_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, id, sim): of every anchor (query_id, vec, `by`) the other rows of its group with a cosine of `at_least` or more.

    The anchors are broadcast in blocks of QUERY_BYTES and held against every row as it is
    scanned, so no group meets in one task however large it is.  Groups are compared as
    text; null groups and vectors, and zero vectors, have no neighbours.
    """
    spark = rows.sparkSession
    named = lambda d, key: d.filter(F.col(by).isNotNull()).select(F.col(key).alias("id"), F.col(by).cast("string").alias("g"), F.col("vec" if key == "query_id" else vec_col).cast("array<double>").alias("vec")).filter("vec IS NOT NULL")
    base, asked = named(rows, id_col), named(anchors, "query_id")
    sizes = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-(sizes["n"] or 0) * (sizes["d"] or 1) * 8 // QUERY_BYTES))
    kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, sim double"
    out = spark.createDataFrame([], kinds)
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vecs = np.stack(part.column("vec").to_numpy())
        shared = spark.sparkContext.broadcast((part.column("id").combine_chunks(), part.column("g").to_numpy(), vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, groups, q = shared.value
            own = names.to_numpy(zero_copy_only=False)
            for batch in batches:
                g = batch.column("g").to_numpy(zero_copy_only=False)
                for group in np.unique(g):
                    to = np.flatnonzero(groups == group)
                    at = np.flatnonzero(g == group)
                    for part in (at[i : i + ROWS] for i in range(0, len(at), ROWS) if len(to)):
                        block = batch.take(pa.array(part))
                        x = np.stack(block.column("vec").to_numpy(zero_copy_only=False))
                        sim = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ q[to].T, 9)
                        row, column = np.nonzero((sim >= at_least) & (block.column("id").to_numpy(zero_copy_only=False)[:, None] != own[to][None, :]))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(to[column])), block.column("id").take(pa.array(row)), pa.array(sim[row, column])], names=["query_id", "id", "sim"])

        out = out.unionByName(base.mapInArrow(near, kinds))
    return out


def terms(text: str | Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def or_terms(query: str | Column) -> Column:
    """The words of an OR query: signs stripped from the end, one particle from words of three letters or more."""
    q = F.col(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.trim(q), r"\s+"), lambda t: t != "")
    bare = F.transform(words, lambda t: F.regexp_replace(t, f"[{SIGNS}]+$", ""))
    cut = F.transform(bare, lambda t: F.when((F.char_length(t) >= 3) & t.rlike(f"[{PARTICLES}]$"), F.left(t, F.char_length(t) - 1)).otherwise(t))
    return F.filter(cut, lambda t: t != "")


def sparse(chunks: DataFrame, queries: DataFrame, k: int | None, id_col: str = "chunk_id", mode: str = "or") -> DataFrame:
    """(query_id, id, score, rank): chunks by occurrences of the query's terms; `and` asks for all of them.

    Without k all hits are given, without ranks: (query_id, id, score).

    Up to MAX_ASKED query terms are broadcast, and every task counts them in its chunks and
    keeps its own k best for each query, so k rows for each query and task are shuffled,
    however common a term is; without k nothing is.  More are joined by term.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))
    few = asked.limit(MAX_ASKED + 1).toArrow()
    hits = _scored(chunks, few, queries.schema["query_id"].dataType.simpleString(), k, id_col, mode == "and") if few.num_rows <= MAX_ASKED else _joined(chunks, asked, id_col, mode == "and")
    if k is None:
        return hits
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _joined(chunks: DataFrame, asked: DataFrame, id_col: str, every: bool) -> DataFrame:
    """(query_id, id, score) of all hits, by a join of terms."""
    tf = chunks.select(id_col, F.explode(terms("text")).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    hits = tf.join(asked, "term").groupBy("query_id", id_col).agg(F.sum("tf").alias("score"), F.count("*").alias("found"))
    if every:
        hits = hits.join(asked.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id").filter("found = wanted")
    return hits.select("query_id", id_col, "score")


def by_term(asked: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The queries' ids and the terms of rows (query_id, term), and the places of the queries that ask for term t: query[first[t] : first[t + 1]]."""
    names, terms_of = asked.column("query_id").combine_chunks().dictionary_encode(), asked.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(terms_of.indices.to_numpy(), kind="stable")
    query, term = names.indices.to_numpy()[order].astype(np.int64), terms_of.indices.to_numpy()[order]
    return names.dictionary, terms_of.dictionary, query, np.searchsorted(term, np.arange(len(terms_of.dictionary) + 1))


def _scored(chunks: DataFrame, asked: pa.Table, kind: str, k: int | None, id_col: str, every: bool) -> DataFrame:
    """(query_id, id, score): each task's k best of every query, or all."""
    shared = chunks.sparkSession.sparkContext.broadcast(by_term(asked))
    rows = chunks.select(F.col(id_col).alias("id"), terms("text").alias("terms"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, query, first = shared.value
        top, kind, n, wanted = _Top(len(names), k or 0), None, len(names), np.bincount(query, minlength=len(names))
        for batch in batches:
            kind = batch.column("id").type
            for at in range(0, batch.num_rows, max(1, ROWS * 200 // max(n, 1))):
                block = batch.slice(at, max(1, ROWS * 200 // max(n, 1)))
                lists, size = block.column("terms"), block.num_rows
                spot = pa.compute.index_in(lists.flatten(), value_set=known)
                row = np.repeat(np.arange(size), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                hit = spot.is_valid().to_numpy(zero_copy_only=False)
                pair, tf = np.unique(row[hit] * len(known) + spot.drop_null().to_numpy(), return_counts=True)
                row, spot = pair // max(len(known), 1), pair % max(len(known), 1)
                each = first[spot + 1] - first[spot]
                to = np.repeat(row * n, each) + query[np.arange(each.sum()) + np.repeat(first[spot] - (np.cumsum(each) - each), each)]
                score = np.bincount(to, weights=np.repeat(tf, each), minlength=size * n).reshape(size, n)
                if every:
                    score[np.bincount(to, minlength=size * n).reshape(size, n) < wanted] = 0
                if k is None:
                    row, to = np.nonzero(score)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(to)), block.column("id").take(pa.array(row)), pa.array(score[row, to].astype(np.int64))], names=["query_id", "id", "score"])
                    continue
                top.add(score, block.column("id").to_numpy(zero_copy_only=False), above=0)
        if kind is not None and k is not None:
            yield top.batch(names, kind, pa.int64(), "score")

    kinds = f"query_id {kind}, id {rows.schema['id'].dataType.simpleString()}, score bigint"
    return rows.mapInArrow(best, kinds).withColumnRenamed("id", id_col)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, rrf, dense_rank, sparse_rank, rank): reciprocal rank fusion of both lists."""
    both = dense_hits.select("query_id", id_col, F.col("rank").alias("dense_rank")).unionByName(sparse_hits.select("query_id", id_col, F.col("rank").alias("sparse_rank")), allowMissingColumns=True)
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.groupBy("query_id", id_col).agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    fused = fused.withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), id_col)
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pool(hits: DataFrame, wanted: Column, k: int) -> DataFrame:
    """The first k wanted hits of each query, in the order of their rank, as `place`."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.filter(wanted).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def merge_pools(pools: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score): of (query_id, pool, rank, id) the sum of 1 / (k + rank); a pool's rank starts at 1."""
    return pools.groupBy("query_id", id_col).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.min_by("pool", F.struct("pool", "rank")).alias("first_pool"))


def decomposed(hits: DataFrame, sub_hits: DataFrame, split: DataFrame, original: int = 20, per_sub: int = 10, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score): queries in `split` (query_id) take the sum of 1 / (60 + rank) over the first
    `original` of their own hits and the first `per_sub` of each sub-query's (query_id, sub_id, id, rank); others keep their rrf."""
    asked = split.select("query_id").distinct()
    pools = hits.join(asked, "query_id", "left_semi").filter(F.col("rank") <= original).select("query_id", F.lit(0).cast("bigint").alias("pool"), "rank", id_col)
    subs = sub_hits.join(asked, "query_id", "left_semi").filter(F.col("rank") <= per_sub).select("query_id", (F.col("sub_id") + 1).cast("bigint").alias("pool"), "rank", id_col)
    rest = hits.join(asked, "query_id", "left_anti").select("query_id", id_col, F.col("rrf").alias("score"))
    return merge_pools(pools.unionByName(subs), id_col).select("query_id", id_col, "score").unionByName(rest)


def with_fallback(fused: DataFrame, sparse_hits: DataFrame, failures: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, fallback): the fused list; where the query's vector could not be had for the time being
    (failures: query_id, transient) the sparse list, scored 1 / (60 + rank); where it never can, nothing."""
    f = failures.select("query_id", "transient")
    fine = fused.join(f, "query_id", "left_anti").select("query_id", id_col, F.col("rrf").alias("score"), F.lit(False).alias("fallback"))
    sparse_only = sparse_hits.join(f.filter("transient"), "query_id", "left_semi").select("query_id", id_col, (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.lit(True).alias("fallback"))
    return fine.unionByName(sparse_only)


def unless_reranked(guarded: Column, score: Column, path: Column) -> Column:
    """The guarded score, but the plain one where a reranker's score, fresh or cached, stands already."""
    return F.when(path.isin("invoked", "cached"), score).otherwise(guarded)


def rerank_key(text: Column, ids: Column) -> Column:
    """What a reranker's answer is kept under: the query without case and outer blanks, and a hash of the sorted ids."""
    names = F.array_sort(F.transform(ids, lambda x: x.cast("string")))
    return F.struct(F.trim(F.lower(text)).alias("query"), F.left(F.sha1(F.array_join(names, "\n").cast("binary")), F.lit(16)).alias("digest"))


def reranked(hits: DataFrame, queries: DataFrame, cache: DataFrame, scores: DataFrame, degraded: DataFrame, cap: int = 20, id_col: str = "chunk_id") -> DataFrame:
    """Hits with `path` and the scores of the path that their query takes.

    cache: (key, id, score) under `rerank_key` of the first `cap` ids; scores: what the reranker
    would give (query_id, id, score).  A whole cached answer comes first; a query in `degraded`
    keeps its own scores; one that the reranker fails to answer does so too.
    """
    first = hits.filter(F.col("rank") <= cap).groupBy("query_id").agg(F.collect_list(id_col).alias("_ids"))
    keyed = first.join(queries.select("query_id", "text"), "query_id").select("query_id", rerank_key(F.col("text"), F.col("_ids")).alias("key"), F.size("_ids").alias("_n"))
    kept = keyed.join(cache.select("key", F.col(id_col), "score"), "key").select("query_id", "_n", id_col, F.col("score").alias("_cached"))
    whole = kept.groupBy("query_id").agg((F.count("*") >= F.max("_n")).alias("_hit")).filter("_hit")
    kept = kept.join(whole, "query_id", "left_semi").drop("_n")
    answered = scores.select("query_id").distinct().withColumn("_answered", F.lit(True))
    rows = hits.join(whole, "query_id", "left").join(degraded.select("query_id").distinct().withColumn("_degraded", F.lit(True)), "query_id", "left").join(answered, "query_id", "left")
    path = F.when(F.col("_hit"), "cached").when(F.col("_degraded"), "degraded").when(F.col("_answered"), "invoked").otherwise("failed")
    rows = rows.withColumn("path", path).join(kept, ["query_id", id_col], "left").join(scores.select("query_id", id_col, F.col("score").alias("_fresh")), ["query_id", id_col], "left")
    near = F.col("rank") <= cap
    score = F.when(near & (F.col("path") == "cached"), F.coalesce("_cached", "rrf")).when(near & (F.col("path") == "invoked"), F.coalesce("_fresh", "rrf")).otherwise(F.col("rrf"))
    return rows.withColumn("rrf", score).drop("_hit", "_degraded", "_answered", "_cached", "_fresh")


def cover_guard(score: Column) -> Column:
    """Short texts at the very start count three tenths."""
    cover = (F.char_length("text") <= 30) & ((F.col("chunk_idx") == 0) | (F.col("page") == 1))
    return F.when(cover, score * 0.3).otherwise(score)


# How a table of contents begins, and how a query asks for one.
TOC = r"(목\s*차)|((^|[\n.\s])(차\s+례|차례)(?=\s|$))"
TOC_ASKED = r"(목\s*차|차\s*례)([가-힣]{0,3})?(?=\s|$|[?!.,])"


def toc_guard(score: Column, text: Column, section: Column, query: Column) -> Column:
    """Chunks read from pictures that begin with a table of contents count three tenths, unless the query asks for one."""
    body = F.when(F.startswith(text, F.lit("[문서]")) & F.contains(text, F.lit("\n\n")), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise(text)
    toc = F.startswith(section, F.lit("(vision)")) & F.left(body, F.lit(100)).rlike(TOC) & ~query.rlike(TOC_ASKED)
    return F.when(toc, score * 0.3).otherwise(score)


def entity_boost(score: Column, mine: Column, asked: Column, factor: float = 1.1) -> Column:
    """Chunks that share an entity with the query count `factor`, kept within 0.5 and 3."""
    return F.when(F.arrays_overlap(mine, asked), score * max(0.5, min(3.0, factor))).otherwise(score)


def by_document(hits: DataFrame, per_doc: int, score: str = "rrf", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, doc_id, doc_score, matched, place, chunks): documents by their best chunk, with
    the best `per_doc` chunks in order of their index."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), id_col)
    ranked = hits.withColumn("_k", F.row_number().over(w))
    docs = ranked.groupBy("query_id", "doc_id").agg(F.max(score).alias("doc_score"), F.count_distinct(id_col).alias("matched"), F.array_sort(F.collect_list(F.when(F.col("_k") <= per_doc, F.col(id_col)))).alias("chunks"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "doc_id"))
    return docs.withColumn("place", place)


def cross_doc_scope(hits: DataFrame, top_docs: int = 4, score: str = "rrf", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, doc_id, doc_score): the documents of the greatest sums of three chunks; none where no score is above 0."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), id_col)
    sums = hits.withColumn("_k", F.row_number().over(w)).filter("_k <= 3").groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 12).alias("doc_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "doc_id"))
    return sums.filter("doc_score > 0").withColumn("place", place).filter(F.col("place") <= top_docs).drop("place")


def doc_rank_boost(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Document scores with 2 / (10 + rank) of the document's own vector added."""
    return docs.join(ranks, ["query_id", "doc_id"], "left").withColumn("doc_score", F.col("doc_score") + F.coalesce(2.0 / (10 + F.col("doc_rank")), F.lit(0.0))).drop("doc_rank")


def mmr(rows: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """(query_id, id, place): maximal marginal relevance over (query_id, id, relevance, vec).

    Greedy, so each query's short list (the ranked pool, not a corpus) goes to one call.
    The first is the most relevant, ties by id; a missing vector is like nothing, and
    likeness below 0 counts 0.
    """

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["relevance", "id"], ascending=[False, True]).reset_index(drop=True)
        vecs = [np.array(v, dtype=float) if v is not None else None for v in pool["vec"]]
        unit = [v / n if v is not None and (n := np.linalg.norm(v)) > 0 else None for v in vecs]
        like, left, out = np.zeros(len(pool)), list(range(len(pool))), []
        while left and len(out) < k:
            best = min(left, key=lambda i: (-(lam * pool["relevance"][i] - (1 - lam) * like[i]), pool["id"][i])) if out else left[0]
            out.append(best)
            left.remove(best)
            for i in left:
                if unit[i] is not None and unit[best] is not None and len(unit[i]) == len(unit[best]):
                    like[i] = max(like[i], float(unit[i] @ unit[best]))
        return pd.DataFrame({"query_id": pool["query_id"][out].to_numpy(), "id": pool["id"][out].to_numpy(), "place": range(1, len(out) + 1)})

    kinds = f"query_id {rows.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, place int"
    return rows.groupBy("query_id").applyInPandas(pick, kinds)


def rerank(hits: DataFrame, scores: DataFrame, cap: int = 20, id_col: str = "chunk_id") -> DataFrame:
    """Hits with the reranker's score for the first `cap`; the others keep theirs."""
    s = scores.select("query_id", id_col, F.col("score").alias("_s"))
    return hits.join(s, ["query_id", id_col], "left").withColumn("rrf", F.when(F.col("rank") <= cap, F.coalesce("_s", "rrf")).otherwise(F.col("rrf"))).drop("_s")


def snippet(text: Column, query: Column, around: int = 240) -> tuple[Column, Column]:
    """The text around the first literal hit, with ellipses, and all hits inside it as [start, end]."""
    at = F.position(F.lower(query), F.lower(text)) - 1
    n, size = F.char_length(query), F.char_length(text)
    begin, end = F.greatest(at - around, F.lit(0)), F.least(at + n + around, size)
    cut = F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < size, "…").otherwise(""))
    hit = (at >= 0) & (n > 0)
    shown = F.when(hit, cut).otherwise(F.left(text, F.lit(2 * around)))
    parts = F.split(F.lower(cut), F.concat(F.lit(r"\Q"), F.lower(query), F.lit(r"\E")), F.lit(-1))
    # The i-th hit starts after i + 1 parts and i queries.
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, p: s + F.char_length(p)) + (i - 1) * n)
    marks = F.when(hit & (F.size(parts) > 1), F.transform(starts, lambda s: F.array(s, s + n))).otherwise(F.array().cast("array<array<int>>"))
    return shown, marks


def context(hits: DataFrame, k: int = 5, chars: int = 1200) -> DataFrame:
    """(query_id, context): the numbered texts of the first k hits, cut to `chars`."""
    cut = F.when(F.char_length("text") > chars, F.concat(F.left("text", F.lit(chars)), F.lit("..."))).otherwise(F.col("text"))
    row = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cut).alias("line"))
    packed = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return packed.select("query_id", F.array_join(F.transform("x", lambda x: x.line), "\n\n").alias("context"))


def dedup_tier(sim: Column, name_ratio: Column) -> Column:
    """2 from similarity 0.95 on, 3 from 0.85 with like names, else null."""
    return F.when(sim >= 0.95, 2).when((sim >= 0.85) & (name_ratio >= 0.6), 3)
