"""Queries of dense, sparse and hybrid retrieval and of ranking.

All benchmark items are the queries; all chunks, or all vectors, are searched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import cells, filters, postings, retrieval, similarity
from lodestar.plans.catalog import query
from lodestar.sources import shared
from lodestar.sources.views import Views, sql

_HITS = r"""cv AS (SELECT c.*, v.vec FROM chunks c JOIN docs d ON d.doc_id = c.doc_id AND d.deleted_at IS NULL JOIN vecs v ON v.doc_id = c.doc_id),
dsim AS (SELECT q.query_id, v.doc_id, round(list_cosine_similarity(v.vec, q.vec), 9) AS sim FROM vecs v, queries q),
dense AS (SELECT * FROM (SELECT s.query_id, c.chunk_id, c.doc_id, sim, row_number() OVER (PARTITION BY s.query_id ORDER BY sim DESC, chunk_id) AS rank FROM dsim s JOIN cv c USING (doc_id)) WHERE rank <= 50),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks JOIN (SELECT doc_id FROM docs WHERE deleted_at IS NULL) USING (doc_id)),
ask AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark_q),
sparse AS (SELECT * FROM (SELECT query_id, chunk_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank FROM tok JOIN ask USING (term) GROUP BY query_id, chunk_id) WHERE rank <= 50),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, min(dr) AS dense_rank, min(sr) AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + min(dr)), 0) + coalesce(1.0::DOUBLE / (60 + min(sr)), 0), 12) AS rrf
  FROM (SELECT query_id, chunk_id, rank AS dr, NULL AS sr FROM dense UNION ALL SELECT query_id, chunk_id, NULL, rank FROM sparse) GROUP BY query_id, chunk_id)) WHERE rank <= 50),
hits AS (SELECT f.*, c.doc_id, c.chunk_idx, c.page, c.text FROM fused f JOIN chunks c USING (chunk_id))""".replace("benchmark_q", "queries")


def _live_chunks(v: Views) -> DataFrame:
    return filters.owned(v.chunks(), filters.tenant(v.docs(), None), "doc_id")


def dense_hits(v: Views, k: int = 50) -> DataFrame:
    """Each chunk has its document's vector; documents are searched first, then their chunks ranked."""
    return retrieval.dense(_live_chunks(v).join(v.vecs(), "doc_id").select("chunk_id", "vec"), v.queries(), k)


def sparse_hits(v: Views, k: int = 50) -> DataFrame:
    return retrieval.sparse(_live_chunks(v), v.queries().select("query_id", "text"), k)


def hybrid(v: Views, k: int = 50) -> DataFrame:
    return retrieval.fuse(dense_hits(v, k), sparse_hits(v, k), k)


def hydrated(v: Views) -> DataFrame:
    return hybrid(v).join(v.chunks(), "chunk_id")


@query("R1_R26_W1_dense_topk", sql("SELECT query_id, doc_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM dsim) WHERE rank <= 50", _HITS))
def r1(v: Views) -> DataFrame:
    return retrieval.dense(v.vecs(), v.queries(), 50, "doc_id").select("query_id", "doc_id", "sim", "rank")


@query("R2_R6_W2_sparse_topk", sql("SELECT query_id, chunk_id, score, rank FROM sparse", _HITS))
def r2(v: Views) -> DataFrame:
    return sparse_hits(v).select("query_id", "chunk_id", "score", "rank")


@query("R5_sparse_all_terms", sql("SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, count(DISTINCT term) AS n FROM tok JOIN ask USING (term) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS wanted FROM ask GROUP BY 1) USING (query_id) WHERE n = wanted", _HITS))
def r5(v: Views) -> DataFrame:
    return retrieval.sparse(_live_chunks(v), v.queries().select("query_id", "text"), None, mode="and").select("query_id", "chunk_id")


def _indexed(v: Views, found: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """What is found for the queries in an index of all live chunks, written in two appends."""
    path, chunks = shared.folder(v.spark, "postings"), _live_chunks(v)
    try:
        for half in (0, 1):
            postings.append(chunks.filter(F.col("doc_id") % 2 == half), path, buckets=16, parts=2)
        return shared.saved(found(path, v.queries().select("query_id", "text")), "hits")
    finally:
        shared.removed(v.spark, path)


@query("R2_posting_index", sql("SELECT query_id, chunk_id, score, rank FROM sparse", _HITS))
def r2_index(v: Views) -> DataFrame:
    return _indexed(v, lambda path, queries: postings.search(path, queries, 50, buckets=16))


@query("R5_posting_index_all_terms", sql("SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, count(*) AS score, count(DISTINCT term) AS n FROM tok JOIN ask USING (term) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS wanted FROM ask GROUP BY 1) USING (query_id) WHERE n = wanted QUALIFY rank <= 50", _HITS))
def r5_index(v: Views) -> DataFrame:
    return _indexed(v, lambda path, queries: postings.search(path, queries, 50, mode="and", buckets=16))


@query("R2_posting_blocks", sql("SELECT query_id, sum(b)::BIGINT AS blocks FROM (SELECT query_id, count(DISTINCT chunk_id // 256) AS b FROM tok JOIN ask USING (term) GROUP BY query_id) GROUP BY query_id", _HITS))
def r2_blocks(v: Views) -> DataFrame:
    """How many blocks hold a term of each query; those opened are told by `opened`."""
    return _indexed(v, lambda path, queries: postings.blocks(path, queries, 50, buckets=16).groupBy("query_id").agg(F.count("*").alias("blocks")))


@query("R1_cell_index", sql("SELECT query_id, doc_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM dsim) WHERE rank <= 50", _HITS))
def r1_cells(v: Views) -> DataFrame:
    """Dense search in stored cells, written in two appends."""
    path, vecs = shared.folder(v.spark, "cells"), v.vecs()
    try:
        centers = cells.fit(vecs, 32)
        for half in (0, 1):
            cells.append(vecs.filter(F.col("doc_id") % 2 == half), path, centers)
        found, _ = cells.search(v.spark, path, v.queries(), 50)
        return shared.saved(found.select("query_id", "doc_id", "sim", "rank"), "hits")
    finally:
        shared.removed(v.spark, path)


@query("R3_hybrid_rrf", sql("SELECT query_id, chunk_id, rrf, dense_rank, sparse_rank, rank FROM fused", _HITS))
def r3(v: Views) -> DataFrame:
    return hybrid(v).select("query_id", "chunk_id", "rrf", "dense_rank", "sparse_rank", "rank")


@query("F8_F9_after_the_cut", sql("SELECT query_id, chunk_id FROM fused WHERE sparse_rank IS NOT NULL AND chunk_id // 1000000 % 2 = 0", _HITS))
def f8(v: Views) -> DataFrame:
    return hybrid(v).filter(F.col("sparse_rank").isNotNull() & (F.floor(F.col("chunk_id") / 1_000_000) % 2 == 0)).select("query_id", "chunk_id")


@query("A1_A2_R17_pool_merge", sql("SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 10) GROUP BY 1, 2", _HITS))
def a2(v: Views) -> DataFrame:
    pools = dense_hits(v).filter("rank <= 20").select("query_id", F.lit(0).alias("pool"), "rank", "chunk_id").union(sparse_hits(v).filter("rank <= 10").select("query_id", F.lit(1), "rank", "chunk_id"))
    return retrieval.merge_pools(pools).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("R8_cover_guard", sql("SELECT query_id, chunk_id, round(CASE WHEN length(text) <= 30 AND (chunk_idx = 0 OR page = 1) THEN rrf * 0.3 ELSE rrf END, 9) AS score FROM hits", _HITS))
def r8(v: Views) -> DataFrame:
    return hydrated(v).select("query_id", "chunk_id", F.round(retrieval.cover_guard(F.col("rrf")), 9).alias("score"))


@query("R21_A3_W7_documents", sql("SELECT query_id, doc_id, doc_score, matched, chunks, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS place FROM (SELECT query_id, doc_id, max(rrf) AS doc_score, count(DISTINCT chunk_id) AS matched, array_to_string(list_sort(list(chunk_id) FILTER (k <= 3)), ',') AS chunks FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rrf DESC, chunk_id) AS k FROM hits) GROUP BY 1, 2)", _HITS))
def r21(v: Views) -> DataFrame:
    docs = retrieval.by_document(hydrated(v), 3)
    return docs.select("query_id", "doc_id", "doc_score", "matched", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"), "place")


@query("A4_R14_cross_doc_scope", sql("SELECT query_id, doc_id, doc_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS p FROM (SELECT query_id, doc_id, round(sum(rrf), 12) AS doc_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rrf DESC, chunk_id) AS k FROM hits) WHERE k <= 3 GROUP BY 1, 2) WHERE doc_score > 0) WHERE p <= 4", _HITS))
def a4(v: Views) -> DataFrame:
    return retrieval.cross_doc_scope(hydrated(v))


@query("R15_W8_doc_vectors", sql("SELECT h.query_id, h.doc_id, round(doc_score + coalesce(2.0::DOUBLE / (10 + rank), 0), 9) AS doc_score FROM (SELECT query_id, doc_id, max(rrf) AS doc_score FROM hits GROUP BY 1, 2) h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM dsim) WHERE rank <= 50) r ON r.query_id = h.query_id AND r.doc_id = h.doc_id", _HITS))
def r15(v: Views) -> DataFrame:
    docs = hydrated(v).groupBy("query_id", "doc_id").agg(F.max("rrf").alias("doc_score"))
    ranks = retrieval.dense(v.vecs(), v.queries(), 50, "doc_id").select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    return retrieval.doc_rank_boost(docs, ranks).select("query_id", "doc_id", F.round("doc_score", 9).alias("doc_score"))


@query("R16_mmr")
def r16(v: Views) -> DataFrame:
    pool = dense_hits(v).select("query_id", F.col("chunk_id").alias("id"), F.col("sim").alias("relevance"))
    vecs = v.vecs().select(F.col("doc_id").alias("_d"), "vec")
    return retrieval.mmr(pool.join(vecs, F.floor(F.col("id") / 1_000_000) == F.col("_d"), "left").drop("_d"), 10)


@query("R18_rerank", sql("SELECT query_id, chunk_id, round(CASE WHEN rank <= 20 AND rank % 2 = 0 THEN rank / 100.0::DOUBLE ELSE rrf END, 9) AS rrf FROM fused", _HITS))
def r18(v: Views) -> DataFrame:
    hits = hybrid(v)
    scores = hits.filter("rank % 2 = 0").select("query_id", "chunk_id", (F.col("rank") / 100.0).alias("score"))
    return retrieval.rerank(hits, scores).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"))


@query("R22_snippets", sql("SELECT chunk_id, CASE WHEN pos > 0 THEN (CASE WHEN pos - 1 > 240 THEN '…' ELSE '' END) || substr(text, greatest(pos - 240, 1), least(pos - 1 + 3 + 240, length(text)) - greatest(pos - 1 - 240, 0)) || (CASE WHEN pos - 1 + 3 + 240 < length(text) THEN '…' ELSE '' END) ELSE left(text, 480) END AS snippet FROM (SELECT chunk_id, text, strpos(lower(text), 'ing') AS pos FROM chunks)"))
def r22(v: Views) -> DataFrame:
    shown, _ = retrieval.snippet(F.col("text"), F.lit("Ing"))
    return v.chunks().select("chunk_id", shown.alias("snippet"))


@query("R22_highlights", sql("SELECT chunk_id, CASE WHEN strpos(lower(text), 'ing') > 0 THEN len(string_split(lower(substr(text, greatest(strpos(lower(text), 'ing') - 240, 1), least(strpos(lower(text), 'ing') + 242, length(text)) - greatest(strpos(lower(text), 'ing') - 241, 0))), 'ing')) - 1 ELSE 0 END AS n FROM chunks"))
def r22b(v: Views) -> DataFrame:
    _, marks = retrieval.snippet(F.col("text"), F.lit("Ing"))
    return v.chunks().select("chunk_id", F.size(marks).alias("n"))


@query("R25_answer_context", sql("SELECT query_id, array_to_string(list('[' || rank || '] ' || (CASE WHEN length(text) > 1200 THEN left(text, 1200) || '...' ELSE text END) ORDER BY rank), chr(10) || chr(10)) AS context FROM hits WHERE rank <= 5 GROUP BY query_id", _HITS))
def r25(v: Views) -> DataFrame:
    return retrieval.context(hydrated(v))


@query("T22_J10_near_duplicates", sql("SELECT id, of, sim FROM (SELECT a.doc_id AS id, b.doc_id AS of, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.doc_id) AS k FROM vecs a JOIN embeddings ea ON ea.vec_id = a.doc_id JOIN embeddings eb ON eb.label = ea.label JOIN vecs b ON b.doc_id = eb.vec_id WHERE a.doc_id <> b.doc_id) WHERE k = 1"))
def t22(v: Views) -> DataFrame:
    rows = v.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return similarity.nearest(rows, "label")


_BLENDED = """r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
twice AS (SELECT id, vec FROM r UNION ALL SELECT a.id + 1000000, list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] + 0.3::DOUBLE * b.vec[i]) FROM r a JOIN r b ON b.id = a.id + 1)"""


@query("J10_threshold_join", sql("SELECT id, of, sim FROM (SELECT a.id, b.id AS of, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS k FROM twice a JOIN twice b ON a.id <> b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 9) >= 0.85) WHERE k = 1", _BLENDED))
def j10(v: Views) -> DataFrame:
    """All vectors, and each blended with the one after it, as one tenant: the nearest at 0.85 or more."""
    own = v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    after = own.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    blended = own.join(after, "id").select((F.col("id") + 1_000_000).alias("id"), F.zip_with("vec", "next", lambda a, b: a + 0.3 * b).alias("vec"))
    return similarity.nearest(own.unionByName(blended).withColumn("all", F.lit("all")), "all", "id", at_least=0.85)


@query("X13_cosine_policy", sql("SELECT a.doc_id, CASE WHEN len(a.v) <> len(b.vec) OR list_sum(list_transform(a.v, lambda x: x * x)) = 0 THEN -1.0::DOUBLE ELSE round(list_cosine_similarity(a.v, b.vec[1:len(a.v)]), 9) END AS sim FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN list_transform(vec, lambda x: 0.0::DOUBLE) WHEN 1 THEN vec[1:3] ELSE vec END AS v FROM vecs) a JOIN vecs b ON b.doc_id = a.doc_id + 1"))
def x13(v: Views) -> DataFrame:
    """Cosine with the next vector; zero vectors and such of another length have the policy's value."""
    i = F.col("doc_id") % 5
    mine = v.vecs().select("doc_id", F.when(i == 0, F.transform("vec", lambda x: F.lit(0.0))).when(i == 1, F.slice("vec", 1, 3)).otherwise(F.col("vec")).alias("a"))
    other = v.vecs().select((F.col("doc_id") - 1).alias("doc_id"), F.col("vec").alias("b"))
    return mine.join(other, "doc_id").select("doc_id", F.round(retrieval.cosine("a", "b", -1.0), 9).alias("sim"))
