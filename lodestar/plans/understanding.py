"""Queries of query understanding, over `asks` and `comments`, whose rows reach every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import queries as Q
from lodestar.functions import text as T
from lodestar.operators import filters, retrieval
from lodestar.plans.catalog import query
from lodestar.plans.retrieval import _HITS, hybrid
from lodestar.sources.views import DOC_TYPES, MODES, Views, sql

TODAY = "2024-01-31"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _matches(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


_SIGNALS = f"""sig AS (SELECT ask_id, q, {_matches("q", Q.CROSS)} AS t1, {_any("q", Q.COMPARE)} OR regexp_matches(q, '{Q.COMPARE_STEM}') AS t2, {_any("q", Q.CAUSE)} AS t3, {_any("q", Q.CHANGE)} AS t4,
  length(q) >= 40 OR len(string_split(q, ' ')) >= 12 AS t5, {_any("q", Q.VAGUE)} AS t6, len(string_split(q, '랑')) + len(string_split(q, '과')) - 2 >= 2 AS two
  FROM (SELECT ask_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM asks)),
fired AS (SELECT ask_id, q, list_filter([CASE WHEN t1 THEN 'T1_cross_doc' END, CASE WHEN t2 THEN 'T2_compare' END, CASE WHEN t3 THEN 'T3_causal' END, CASE WHEN t4 THEN 'T4_change' END, CASE WHEN t5 THEN 'T5_long_query' END, CASE WHEN t6 THEN 'T6_low_confidence' END, CASE WHEN NOT t1 AND two THEN 'T7_multi_target' END], lambda x: x IS NOT NULL) AS s FROM sig)""".replace("\\\\", "\\")


@query("Q2_Q5_signals", sql("SELECT ask_id, array_to_string(s, ',') AS fired FROM fired", _SIGNALS))
def q2(v: Views) -> DataFrame:
    return v.asks().select("ask_id", F.array_join(Q.signals(F.col("text")), ",").alias("fired"))


@query("Q3_Q4_decomposition_and_confidence", sql("SELECT ask_id, list_has_any(s, ['T1_cross_doc', 'T2_compare', 'T3_causal', 'T7_multi_target']) OR list_has_all(s, ['T5_long_query', 'T6_low_confidence']) AS decompose, round(greatest(0, least(1, 1 - 0.15::DOUBLE * len(s) - CASE WHEN list_contains(s, 'T6_low_confidence') THEN 0.3 ELSE 0 END)), 6) AS confidence FROM fired", _SIGNALS))
def q3(v: Views) -> DataFrame:
    fired = v.asks().select("ask_id", Q.signals(F.col("text")).alias("s"))
    return fired.select("ask_id", Q.needs_decomposition(F.col("s")).alias("decompose"), F.round(Q.confidence(F.col("s")), 6).alias("confidence"))


_WORDS = dict(Q.LABELS)
_CROSSED = " OR ".join(f"(contains(q, '{a}') AND contains(source, '{b}') AND NOT contains(source, '{a}')) OR (contains(q, '{b}') AND contains(source, '{a}') AND NOT contains(source, '{b}'))" for a, b in Q.SYNONYMS)
_LABELLED = f"""labelled AS (SELECT ask_id, q, CASE WHEN negative THEN 'out_of_scope' WHEN {_any("q", _WORDS["vision_diagram"])} THEN 'vision_diagram' WHEN {_any("q", _WORDS["table_lookup"])} THEN 'table_lookup' WHEN {_any("q", _WORDS["cross_doc"])} THEN 'cross_doc'
  WHEN {_matches("q", Q.NUMERIC)} OR {_any("q", _WORDS["numeric_lookup"])} THEN 'numeric_lookup' WHEN {_any("q", _WORDS["summary"])} THEN 'summary' WHEN {_CROSSED} THEN 'synonym_mismatch' WHEN {_any("q", _WORDS["fuzzy_memory"])} THEN 'fuzzy_memory' ELSE 'exact_fact' END AS label
  FROM (SELECT ask_id, trim(text) AS q, source, negative FROM asks))"""
_NINE = ["out_of_scope", "synonym_mismatch", *_WORDS, "exact_fact"]


def _labelled(v: Views) -> DataFrame:
    asked = v.asks().filter(F.trim("text") != "")
    return asked.select("ask_id", Q.label(F.col("text"), F.col("source"), F.col("negative")).alias("label"))


@query("Q6_query_labels", sql("SELECT ask_id, label FROM labelled WHERE q <> ''", _LABELLED))
def q6(v: Views) -> DataFrame:
    return _labelled(v)


def _spine(v: Views, names: list[str], counts: DataFrame) -> DataFrame:
    spine = v.spark.createDataFrame([(x,) for x in names], "label string")
    return spine.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("A23_query_type_distribution", sql(f"SELECT l.label, count(x.ask_id) AS n FROM (SELECT unnest({_NINE}) AS label) l LEFT JOIN (SELECT * FROM labelled WHERE q <> '' AND ask_id % 4 < 2) x ON x.label = l.label GROUP BY 1", _LABELLED))
def a23(v: Views) -> DataFrame:
    """All nine labels, those without a query with 0; the queries are those of two out of four channels."""
    return _spine(v, _NINE, _labelled(v).filter("ask_id % 4 < 2").groupBy("label").agg(F.count("*").alias("n")))


_SAID = f"""said AS (SELECT doc_id, CASE WHEN {_any("c", dict(Q.COMMENTS)["source_issue"])} THEN 'source_issue' WHEN {_any("c", dict(Q.COMMENTS)["search_issue"])} THEN 'search_issue' WHEN {_any("c", dict(Q.COMMENTS)["answer_issue"])} THEN 'answer_issue' ELSE 'other' END AS label
  FROM (SELECT doc_id, lower(trim(comment)) AS c FROM comments WHERE trim(coalesce(comment, '')) <> ''))"""


@query("Q10_comment_labels", sql("SELECT doc_id, label FROM said", _SAID))
def q10(v: Views) -> DataFrame:
    return v.comments().filter(F.trim(F.coalesce("comment", F.lit(""))) != "").select("doc_id", Q.comment_label(F.col("comment")).alias("label"))


@query("A24_comment_distribution", sql("SELECT l.label, count(x.doc_id) AS n FROM (SELECT unnest(['source_issue', 'search_issue', 'answer_issue', 'other']) AS label) l LEFT JOIN said x ON x.label = l.label GROUP BY 1", _SAID))
def a24(v: Views) -> DataFrame:
    return _spine(v, [*dict(Q.COMMENTS), "other"], q10(v).groupBy("label").agg(F.count("*").alias("n")))


_PARSED = rf"""parsed AS (SELECT *, CASE WHEN iso <> '' THEN try_cast(regexp_replace(iso, '[./]', '-', 'g') AS DATE) WHEN ko <> '' THEN make_date(regexp_extract(ko, '(\d+)\s*년', 1)::INT, regexp_extract(ko, '(\d+)\s*월', 1)::INT, regexp_extract(ko, '(\d+)\s*일', 1)::INT)
    WHEN mo <> '' THEN make_date(regexp_extract(mo, '(\d+)\s*년', 1)::INT, regexp_extract(mo, '(\d+)\s*월', 1)::INT, 1) WHEN contains(q, '어제') THEN DATE '2024-01-30' WHEN contains(q, '지난주') THEN DATE '2024-01-18' END AS d1,
    CASE WHEN iso <> '' OR ko <> '' THEN 1 WHEN mo <> '' THEN 31 WHEN contains(q, '어제') THEN 1 WHEN contains(q, '지난주') THEN 7 END AS days,
    list_filter(string_split(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '#[A-Za-z0-9가-힣_\-]+', ' ', 'g'), '\d{{4}}[-./]\d{{1,2}}[-./]\d{{1,2}}', ' ', 'g'), '\d{{4}}\s*년\s*\d{{1,2}}\s*월\s*\d{{1,2}}\s*일', ' ', 'g'), '\d{{4}}\s*년\s*\d{{1,2}}\s*월', ' ', 'g'), '어제', ' '), '지난주', ' '), '\s+', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM (SELECT ask_id, q, list_distinct(regexp_extract_all(q, '#([A-Za-z0-9가-힣_\-]+)', 1)) AS tags, regexp_extract(q, '\d{{4}}[-./]\d{{1,2}}[-./]\d{{1,2}}') AS iso, regexp_extract(q, '\d{{4}}\s*년\s*\d{{1,2}}\s*월\s*\d{{1,2}}\s*일') AS ko, regexp_extract(q, '\d{{4}}\s*년\s*\d{{1,2}}\s*월') AS mo
    FROM (SELECT ask_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM asks))),
named AS (SELECT *, list_filter(list_transform(words, lambda w: CASE WHEN length(w) >= 2 AND right(w, 1) IN ({", ".join(f"'{x}'" for x in Q.PARTICLES)}) THEN left(w, length(w) - 1) ELSE w END), lambda w: NOT list_contains({Q.REQUESTS}, w)) AS name FROM parsed),
judged AS (SELECT *, len(words) <= 5 AND len(name) > 0 AND (d1 IS NOT NULL OR len(tags) > 0 OR len(list_filter(name, lambda w: {_any("w", Q.SUFFIXES)})) > 0) AS named,
  len(list_filter(words, lambda w: {_any("w", Q.QUESTIONS)})) > 0 AS question FROM named),
plan AS (SELECT ask_id, concat_ws('+', CASE WHEN d1 IS NOT NULL THEN 'date' END, CASE WHEN len(tags) > 0 THEN 'tag' END, CASE WHEN named THEN 'title' END) AS kind, d1, d1 + days::INT AS d2, tags, CASE WHEN named THEN array_to_string(name, ' ') END AS title
  FROM judged WHERE NOT question AND (named OR len(name) = 0) AND (named OR d1 IS NOT NULL OR len(tags) > 0))""".replace("\\\\", "\\")


def _planned(v: Views) -> DataFrame:
    return v.asks().select("ask_id", Q.filter_plan(F.col("text"), TODAY).alias("plan")).filter("plan IS NOT NULL").select("ask_id", "plan.*")


@query("Q7_Q8_Q9_filter_plans", sql("SELECT ask_id, kind, strftime(d1, '%Y-%m-%d') AS first, strftime(d2, '%Y-%m-%d') AS last, array_to_string(list_sort(tags), ',') AS tags, title FROM plan", _PARSED))
def q9(v: Views) -> DataFrame:
    return _planned(v).select("ask_id", "kind", F.col("start").cast("string").alias("first"), F.col("end").cast("string").alias("last"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "title")


@query("F10_query_validation", sql(f"""SELECT ask_id, CASE WHEN trim(text) = '' THEN 'empty_query' WHEN length(text) > 200 THEN 'long_query' WHEN t IS NOT NULL AND NOT list_contains({DOC_TYPES}, t) THEN 'doc_type' WHEN d IS NOT NULL AND (trim(d) = '' OR length(trim(d)) > 64) THEN 'doc_id' WHEN m IS NULL OR NOT list_contains({MODES}, m) THEN 'mode' END AS problem
  FROM (SELECT ask_id, CASE WHEN ask_id % 19 = 0 THEN repeat(text || '.', 60) ELSE text END AS text, CASE ask_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'exe' END AS t, CASE ask_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN repeat('d', 65) WHEN 2 THEN 'd1' END AS d, CASE ask_id % 4 WHEN 0 THEN 'fuzzy' WHEN 1 THEN NULL ELSE 'dense' END AS m FROM asks)"""))
def f10(v: Views) -> DataFrame:
    i, text = F.col("ask_id"), F.col("text")
    long = F.when(i % 19 == 0, F.repeat(F.concat(text, F.lit(".")), F.lit(60))).otherwise(text)
    kind, own = F.when(i % 5 == 0, "pdf").when(i % 5 == 1, "exe"), F.when(i % 7 == 0, " ").when(i % 7 == 1, "d" * 65).when(i % 7 == 2, "d1")
    mode = F.when(i % 4 == 0, "fuzzy").when(i % 4 > 1, "dense")
    return v.asks().select("ask_id", Q.problem(long, kind, mode, own, DOC_TYPES, MODES).alias("problem"))


_FAST = """fast AS (SELECT ask_id, doc_id, row_number() OVER (PARTITION BY ask_id ORDER BY created_at DESC, doc_id) AS place
  FROM plan JOIN docs ON deleted_at IS NULL AND (d1 IS NULL OR (created_at >= d1 AND created_at < d2)) AND list_has_all(docs.tags, plan.tags) AND (plan.title IS NULL OR contains(lower(docs.title), lower(plan.title))) WHERE ask_id % 20 = 0)"""


@query("R24_fast_path", sql("SELECT ask_id, CASE WHEN doc_id IS NULL THEN 'rag' ELSE 'fast' END AS path, doc_id, place FROM (SELECT ask_id FROM asks WHERE ask_id % 20 = 0) a LEFT JOIN (SELECT * FROM fast WHERE place <= 20) f USING (ask_id)", _PARSED, _FAST))
def r24(v: Views) -> DataFrame:
    """Of every query whose id is divisible by 20 the newest 20 documents that its plan finds; a query without
    a plan, or whose plan finds none, takes the search path."""
    asked = v.asks().filter("ask_id % 20 = 0").select("ask_id")
    plans = _planned(v).filter("ask_id % 20 = 0")
    found = filters.by_plan(filters.tenant(v.docs(), None), plans, 20)
    return asked.join(found, "ask_id", "left").select("ask_id", F.when(F.col("doc_id").isNull(), "rag").otherwise("fast").alias("path"), "doc_id", "place")


@query("Q13_term_pairs", sql("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 6 = 1 THEN 8 ELSE 1 END AS n, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN lang || '1=a' ELSE lang || '=a,b' END AS first FROM documents"))
def q13(v: Views) -> DataFrame:
    """Answers of three kinds: no JSON, ten fenced pairs, and one good pair among bad ones."""
    lang, i = F.col("lang"), F.col("doc_id") % 6
    pair = lambda term, synonyms: F.concat(F.lit('{"term": "'), term, F.lit(f'", "synonyms": {synonyms}}}'))
    ten = F.concat(F.lit('```json\n{"pairs": ['), F.concat_ws(", ", *[pair(F.concat(lang, F.lit(str(k))), '["a"]') for k in range(1, 11)]), F.lit("]}\n```"))
    one = F.concat(F.lit('{"pairs": ['), F.concat_ws(", ", pair(F.lit(" "), '["x"]'), pair(lang, '[" a", "", "b "]'), pair(F.lit("t"), "[]")), F.lit("]}"))
    found = v.table("documents").select("doc_id", Q.term_pairs(F.when(i == 0, "no pairs here").when(i == 1, ten).otherwise(one)).alias("p"))
    first = F.get("p", F.lit(0))
    return found.select("doc_id", F.size("p").alias("n"), F.concat(first.term, F.lit("="), F.array_join(first.synonyms, ",")).alias("first"))


@query("N23_answer_pool", sql("SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fused WHERE query_id % 2 = 1 OR chunk_id // 1000000 % 2 = query_id // 2 % 2 QUALIFY place <= 10", _HITS))
def n23(v: Views) -> DataFrame:
    """The pool of an answer: the hybrid hits, those of the wanted documents where a query names some, the first ten."""
    wanted = (F.col("query_id") % 2 == 1) | (F.floor(F.col("chunk_id") / 1_000_000) % 2 == F.floor(F.col("query_id") / 2) % 2)
    return retrieval.pool(hybrid(v), wanted, 10).select("query_id", "chunk_id", "place")


@query("Q1_nfc_queries", sql("SELECT ask_id, nfc_normalize(text) AS text FROM asks"))
def q1(v: Views) -> DataFrame:
    """Queries come decomposed and are composed again."""
    jamo = F.col("text")
    return v.asks().select("ask_id", T.nfc(T.nfd(jamo)).alias("text"))


@query("C23_C24_evaluation_tables", sql(r"SELECT item_id::VARCHAR AS id, md5(trim(regexp_replace(left(text, 60), '\s+', ' ', 'g'))) AS query, CASE WHEN item_id % 3 = 0 THEN 'a:' || item_id % 7 || ',b:' || item_id % 5 WHEN item_id % 3 = 1 THEN (item_id % 7)::VARCHAR ELSE '' END AS labels FROM benchmark"))
def c23(v: Views) -> DataFrame:
    """A golden set that goes out as CSV with a byte order mark in its header, and comes back."""
    from lodestar.sources import evaluation, shared

    i = F.col("item_id")
    labels = F.when(i % 3 == 0, F.concat(F.lit("a:"), (i % 7).cast("string"), F.lit(" | b:"), (i % 5).cast("string"))).when(i % 3 == 1, (i % 7).cast("string")).otherwise("")
    out = v.table("benchmark").select(i.alias("﻿id"), F.left("text", F.lit(60)).alias("query"), labels.alias("relevant_chunks"))
    path = f"{shared.folder(v.spark, 'evaluation')}.csv"
    out.write.option("header", True).option("escape", '"').csv(path)
    rows = evaluation.table(v.spark, path)
    found = F.transform(evaluation.chunk_labels("relevant_chunks"), lambda x: F.concat(F.coalesce(F.concat(x["alias"], F.lit(":")), F.lit("")), x["idx"].cast("string")))
    told = rows.select("id", F.md5(F.trim(F.regexp_replace("query", r"\s+", " ")).cast("binary")).alias("query"), F.array_join(found, ",").alias("labels"))
    try:
        return shared.saved(told, "evaluation")
    finally:
        shared.removed(v.spark, path)
