"""Queries of retrieval quality over benchmark items as queries and documents as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import metrics, percentiles
from lodestar.plans.catalog import query
from lodestar.sources.views import Views, sql

# Predictions of a fixed rule, so that both engines rank the same: query q ranks documents (q * 7 + 13 * r) mod 200.
_EVAL = """preds AS (SELECT item_id AS query_id, r AS rank, (item_id * 7 + 13 * r) % 200 AS item FROM benchmark, (SELECT unnest(range(1, 11)) AS r)),
lab AS (SELECT item_id AS query_id, (item_id * 7 + 39) % 200 AS item, 1.0::DOUBLE AS grade FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, (item_id * 7 + 13) % 200, 0.5 FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT item_id, (item_id * 7 + 5) % 200, 1.0 FROM benchmark WHERE item_id % 5 = 0),
g AS (SELECT p.query_id, p.rank, coalesce(l.grade, 0) AS grade FROM preds p LEFT JOIN lab l ON l.query_id = p.query_id AND l.item = p.item),
ideal AS (SELECT query_id, sum(grade) FILTER (k <= 10) AS ideal, sum(grade / log2(k + 1)) FILTER (k <= 10) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS k FROM lab) GROUP BY query_id),
m AS (SELECT b.item_id AS query_id, coalesce(got / ideal, 0) AS recall, CASE WHEN ideal > 0 THEN coalesce(rr, 0) ELSE 0 END AS mrr, coalesce(dcg / idcg, 0) AS ndcg, coalesce(top1, false) AS top1
  FROM benchmark b LEFT JOIN (SELECT query_id, sum(grade) AS got, sum(grade / log2(rank + 1)) AS dcg, arg_min(grade / rank, rank) FILTER (grade > 0) AS rr, bool_or(rank = 1 AND grade > 0) AS top1 FROM g GROUP BY query_id) x ON x.query_id = b.item_id LEFT JOIN ideal ON ideal.query_id = b.item_id)"""


def predictions(v: Views) -> DataFrame:
    b = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    return b.withColumn("item", (F.col("query_id") * 7 + F.col("rank") * 13) % 200)


def labels(v: Views) -> DataFrame:
    b = v.table("benchmark").select(F.col("item_id").alias("query_id"))
    of = lambda n, plus, grade: b.filter(n).select("query_id", ((F.col("query_id") * 7 + plus) % 200).alias("item"), F.lit(grade).alias("grade"))
    return of("query_id % 3 <> 0", 39, 1.0).union(of("query_id % 4 = 0", 13, 0.5)).union(of("query_id % 5 = 0", 5, 1.0))


def measured(v: Views) -> DataFrame:
    return metrics.per_query(v.table("benchmark").select(F.col("item_id").alias("query_id")), predictions(v), labels(v), 10)


@query("M1_M5_per_query", sql("SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, top1 FROM m", _EVAL))
def m1(v: Views) -> DataFrame:
    return measured(v).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "top1")


@query("A31_means", sql("SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m", _EVAL))
def a31(v: Views) -> DataFrame:
    return measured(v).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("A32_grouping_sets", sql("SELECT qtype, kind, GROUPING_ID(qtype, kind)::INT AS level, count(*) AS n, round(avg(recall), 6) AS recall, round(min(recall), 6) AS recall_low, round(max(recall), 6) AS recall_high, round(stddev_pop(recall), 6) AS recall_spread, round(avg(mrr), 6) AS mrr, round(min(mrr), 6) AS mrr_low, round(max(mrr), 6) AS mrr_high, round(stddev_pop(mrr), 6) AS mrr_spread, round(avg(ndcg), 6) AS ndcg, round(min(ndcg), 6) AS ndcg_low, round(max(ndcg), 6) AS ndcg_high, round(stddev_pop(ndcg), 6) AS ndcg_spread, count(*) FILTER (recall = 0) AS missed, count(*) FILTER (recall >= 1) AS whole FROM (SELECT *, query_id % 4 AS qtype, query_id % 3 AS kind FROM m) GROUP BY GROUPING SETS ((qtype), (kind), (qtype, kind), ())", _EVAL))
def a32(v: Views) -> DataFrame:
    rows = measured(v).withColumn("qtype", F.col("query_id") % 4).withColumn("kind", F.col("query_id") % 3)
    return metrics.summary(rows, ["qtype", "kind"], ["recall", "mrr", "ndcg"])


@query("A33_A34_A35_spread_and_threshold", sql("SELECT qtype, mean, pstdev, low, high, round(greatest(0.1, greatest(0, mean - 2 * pstdev)), 6) AS threshold, mean < greatest(0.1, greatest(0, mean - 2 * pstdev)) AS below FROM (SELECT query_id % 4 AS qtype, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS pstdev, round(min(ndcg), 6) AS low, round(max(ndcg), 6) AS high FROM m GROUP BY 1)", _EVAL))
def a33(v: Views) -> DataFrame:
    s = metrics.spread(measured(v).withColumn("qtype", F.col("query_id") % 4), "qtype", "ndcg")
    t = metrics.threshold(F.col("mean"), F.col("pstdev"), 0.1)
    return s.select("qtype", "mean", "pstdev", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(t, 6).alias("threshold"), (F.col("mean") < t).alias("below"))


@query("M6_W15_expected_rank", sql("SELECT b.item_id AS query_id, min(rank) AS rank, coalesce(min(rank) <= 3, false) AS top3 FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id AND grade > 0 GROUP BY 1", _EVAL))
def m6(v: Views) -> DataFrame:
    hits = metrics.graded(predictions(v), labels(v)).filter("grade > 0").groupBy("query_id").agg(F.min("rank").alias("rank"))
    q = v.table("benchmark").select(F.col("item_id").alias("query_id"))
    return q.join(hits, "query_id", "left").select("query_id", "rank", F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("top3"))


@query("M7_M8_context", sql("SELECT b.item_id AS query_id, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(hit, 0)::DOUBLE / n END AS recall, coalesce(1.0::DOUBLE / first, 0) AS precision FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n FROM lab GROUP BY 1) l ON l.query_id = b.item_id LEFT JOIN (SELECT query_id, count(*) AS hit, min(rank) AS first FROM g WHERE grade > 0 GROUP BY 1) h ON h.query_id = b.item_id", _EVAL))
def m7(v: Views) -> DataFrame:
    n = labels(v).groupBy("query_id").agg(F.count("*").alias("n"))
    h = metrics.graded(predictions(v), labels(v)).filter("grade > 0").groupBy("query_id").agg(F.count("*").alias("hit"), F.min("rank").alias("first"))
    q = v.table("benchmark").select(F.col("item_id").alias("query_id")).join(n, "query_id", "left").join(h, "query_id", "left")
    return q.select("query_id", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("precision"))


@query("M11_zero_for_missing_document", sql("SELECT round(avg(CASE WHEN d.doc_id IS NULL THEN 0.0::DOUBLE ELSE grade END), 6) AS mean, count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS missing FROM lab LEFT JOIN (SELECT doc_id FROM docs WHERE deleted_at IS NULL AND NOT failed) d ON d.doc_id = item", _EVAL))
def m11(v: Views) -> DataFrame:
    """Labels of documents that are gone or failed count 0."""
    known = v.docs().filter("deleted_at IS NULL AND NOT failed").select(F.col("doc_id").alias("item"), F.lit(True).alias("known"))
    rows = labels(v).join(known, "item", "left")
    return rows.agg(F.round(F.avg(F.when(F.col("known"), F.col("grade")).otherwise(0.0)), 6).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("M13_must_include", sql("SELECT doc_id, len(list_filter(['the', 'and', 'ing'], lambda t: contains(text, t))) AS hits FROM docs"))
def m13(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.size(F.filter(F.split(F.lit("the;and;ing"), ";"), lambda t: F.contains(F.col("text"), t))).alias("hits"))


@query("M16_cost_guard", sql("""SELECT event_id, CASE WHEN brk THEN 'break' WHEN high AND sum(high::INT) OVER (PARTITION BY user_key ORDER BY called_at, event_id) = 1 THEN 'alert' ELSE 'proceed' END AS action FROM (
  SELECT *, spent + 0.002 > 0.05 + 1e-9 AS brk, NOT (spent + 0.002 > 0.05 + 1e-9) AND spent + 1e-9 >= 0.04 AS high FROM (SELECT event_id, user_key, called_at, coalesce(sum(greatest(cost, 0)) OVER (PARTITION BY user_key ORDER BY called_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM usage))"""))
def m16(v: Views) -> DataFrame:
    return metrics.cost_guard(v.usage(), "user_key", ["called_at", "event_id"], 0.05, 0.002).select("event_id", "action")


@query("M17_ablation_by_mode", sql("SELECT mode, count(*) AS n, round(avg(CASE WHEN top1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN top3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3, round(avg(took_ms), 6) AS avg_ms FROM (SELECT mode, query_id, any_value(took_ms) AS took_ms, bool_or(rank = 1 AND hit) AS top1, bool_or(rank <= 3 AND hit) AS top3 FROM (SELECT p.*, ['hybrid', 'dense', 'sparse'][m + 1] AS mode, query_id % 50 + 10.0::DOUBLE * m AS took_ms, EXISTS (SELECT 1 FROM lab WHERE lab.query_id = p.query_id AND lab.item = (p.item + 13 * m) % 200) AS hit FROM preds p, (SELECT unnest([0, 1, 2]) AS m)) GROUP BY 1, 2) GROUP BY mode", _EVAL))
def m17(v: Views) -> DataFrame:
    """Each mode ranks the documents by a step of its own."""
    m = F.col("m")
    runs = predictions(v).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    runs = runs.select(F.get(F.array(F.lit("hybrid"), F.lit("dense"), F.lit("sparse")), m).alias("mode"), "query_id", "rank", ((F.col("item") + 13 * m) % 200).alias("item"), (F.col("query_id") % 50 + 10.0 * m).alias("took_ms"))
    return metrics.ablation(runs, labels(v))


@query("N2_select_and_cap", sql("SELECT query_id, array_to_string(list_sort(list(item)), ',') AS items FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS k FROM (SELECT query_id, item, (item % 10) / 10.0::DOUBLE AS s FROM preds) WHERE s >= 0.5) WHERE k <= 3 GROUP BY query_id", _EVAL))
def n2(v: Views) -> DataFrame:
    scored = predictions(v).withColumn("s", (F.col("item") % 10) / 10.0)
    return metrics.selected(scored, "query_id", "item", "s", 0.5, 3).select("query_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("N3_skip_reasons", sql("SELECT CASE WHEN doc_id % 7 = 0 THEN 'already_filled' WHEN failed THEN 'negative' WHEN deleted_at IS NOT NULL THEN 'no_doc_id' ELSE 'selected' END AS reason, count(*) AS n FROM docs GROUP BY 1"))
def n3(v: Views) -> DataFrame:
    reason = F.when(F.col("doc_id") % 7 == 0, "already_filled").when(F.col("failed"), "negative").when(F.col("deleted_at").isNotNull(), "no_doc_id").otherwise("selected")
    return v.docs().groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("N9_spread_rows", sql("SELECT query_id, count(DISTINCT item // 50) AS docs FROM preds WHERE rank <= 5 GROUP BY 1 HAVING count(DISTINCT item // 50) >= 3", _EVAL))
def n9(v: Views) -> DataFrame:
    top = predictions(v).filter("rank <= 5").groupBy("query_id").agg(F.count_distinct(F.floor(F.col("item") / 50)).alias("docs"))
    return top.filter("docs >= 3")


@query("N10_best_configuration", sql("SELECT arg_max(mode, (round(hit, 2), -ms)) AS best FROM (SELECT mode, avg(CASE WHEN fused > 0 THEN 1.0 ELSE 0 END) AS hit, quantile_cont(took_ms, 0.95) AS ms FROM search_log GROUP BY mode)"))
def n10(v: Views) -> DataFrame:
    rows = v.search_log().groupBy("mode").agg(F.avg((F.col("fused") > 0).cast("double")).alias("hit")).join(percentiles.interpolated(v.search_log(), ["mode"], "took_ms", ms=0.95), "mode")
    return rows.agg(F.max_by("mode", F.struct(F.round("hit", 2), -F.col("ms"))).alias("best"))


@query("N12_measurable_rate", sql("SELECT avg(CASE WHEN received_ms IS NULL THEN NULL WHEN received_ms < 2000 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM docs"))
def n12(v: Views) -> DataFrame:
    return v.docs().agg(F.avg((F.col("received_ms") < 2000).cast("double")).alias("rate"))


@query("N16_fixed_domain", sql("SELECT t AS doc_type, count(d.doc_id) AS n FROM (SELECT unnest(['pdf', 'url', 'epub']) AS t) LEFT JOIN docs d ON d.doc_type = t GROUP BY t"))
def n16(v: Views) -> DataFrame:
    spine = v.spark.createDataFrame([("pdf",), ("url",), ("epub",)], "doc_type string")
    return spine.join(v.docs(), "doc_type", "left").groupBy("doc_type").agg(F.count("doc_id").alias("n"))


@query("N21_verdict_bands", sql("SELECT user_id, CASE WHEN d >= 2 THEN 'ok' WHEN d >= -5 THEN 'minor' ELSE 'regression' END AS verdict FROM (SELECT user_id, count(*) FILTER (scan) - count(*) FILTER (failed) * 4 AS d FROM docs GROUP BY user_id)"))
def n21(v: Views) -> DataFrame:
    rows = v.docs().groupBy("user_id").agg((F.count_if("scan") - F.count_if("failed") * 4).alias("d"))
    return rows.select("user_id", metrics.verdict(F.col("d")).alias("verdict"))


@query("N18_cache_misses", sql("SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, page FROM chunks) WHERE (doc_id, page) NOT IN (SELECT doc_id, page FROM chunks WHERE doc_id % 2 = 0)"))
def n18(v: Views) -> DataFrame:
    pages = v.chunks().select("doc_id", "page").distinct()
    return pages.join(pages.filter("doc_id % 2 = 0"), ["doc_id", "page"], "left_anti").agg(F.count("*").alias("n"))
