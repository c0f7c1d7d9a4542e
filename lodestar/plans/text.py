"""Queries of the text pipeline and of query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import queries as Q
from lodestar.functions import text as T
from lodestar.operators import chunks as C
from lodestar.plans.catalog import query
from lodestar.sources.views import Views, sql

_REASON = r"""marked AS (SELECT doc_id, chunk_id, text, CASE WHEN length(bare) = 0 THEN 'empty' WHEN length(bare) < 20 AND NOT regexp_matches(bare, '\p{L}') THEN 'extreme_short' WHEN length(bare) < 100 AND n >= 3 THEN 'header_footer' WHEN length(text) < 50 THEN NULL
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 30))::DOUBLE / len(string_split(text, chr(10))) >= 0.9 AND coalesce(length(regexp_replace(text, '\p{L}', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0) >= 0.7 THEN 'table_noise' END AS reason
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS n FROM (SELECT *, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS bare FROM chunks)))"""


@query("T10_A30_chunk_filter", sql("SELECT chunk_id, reason FROM marked WHERE reason IS NOT NULL", _REASON))
def t10(v: Views) -> DataFrame:
    return C.marked(v.chunks()).filter("reason IS NOT NULL").select("chunk_id", "reason")


@query("A10_T12_quality_rollup", sql("SELECT count(*) AS total, count(reason) AS filtered, coalesce(count(reason)::DOUBLE / nullif(count(*), 0) > 0.05, false) AS warning, (SELECT coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') FROM (SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY reason)) AS breakdown FROM marked", _REASON))
def a10(v: Views) -> DataFrame:
    return C.rollup(C.marked(v.chunks()))


@query("F2_searchable", sql("SELECT doc_id, count(*) AS n FROM marked WHERE reason IS NULL GROUP BY doc_id", _REASON))
def f2(v: Views) -> DataFrame:
    return C.marked(v.chunks()).filter("reason IS NULL").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("A28_T13_chunk_statistics", sql(r"""SELECT doc_id, count(*) AS n, round(avg(length(text)), 1) AS mean_chars, trunc(quantile_cont(length(text), 0.5))::INT AS median_chars, round(avg(CASE WHEN length(text) >= 400 THEN 1.0::DOUBLE ELSE 0 END), 3) AS filled,
  round(avg(CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 30))::DOUBLE / len(string_split(text, chr(10))) >= 0.7 AND coalesce(length(regexp_replace(text, '\p{L}', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 3) AS noisy FROM chunks GROUP BY doc_id"""))
def a28(v: Views) -> DataFrame:
    return C.statistics(v.chunks())


@query("A29_global_lengths", sql("SELECT count(*) AS n, list_sort(list(c))[(floor(0.5 * (count(*) - 1)) + 1)::INT] AS p50, list_sort(list(c))[(floor(0.95 * (count(*) - 1)) + 1)::INT] AS p95 FROM (SELECT length(text) AS c FROM chunks)"))
def a29(v: Views) -> DataFrame:
    from lodestar.operators import percentiles

    return percentiles.nearest(v.chunks().select(F.char_length("text").alias("c")), [], "c", p50=0.5, p95=0.95)


@query("T7_table_cells", sql(r"SELECT chunk_id FROM chunks WHERE contains(text, ' | ') OR (length(text) < 30 AND length(text) > 0 AND 2 * length(regexp_replace(text, '[\p{L}\s]', '', 'g')) >= length(text))"))
def t7(v: Views) -> DataFrame:
    return v.chunks().filter(T.is_table_cell(F.col("text"))).select("chunk_id")


@query("T15_T17_documents_with_cards", sql(r"SELECT doc_id, len(regexp_extract_all(text, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,7}\b')) AS n FROM docs WHERE regexp_matches(text, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,7}\b')"))
def t15(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.size(T.cards(F.col("text"))).alias("n")).filter("n > 0")


@query("T15_pii_ranges")
def t15b(v: Views) -> DataFrame:
    return v.chunks().select("chunk_id", F.explode(T.pii_ranges(F.col("text"))).alias("r")).select("chunk_id", "r.start", "r.end")


@query("T16_watermarks", sql("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)대외비|내부자료|보안|CONFIDENTIAL|INTERNAL'))), ',') AS hits FROM docs"))
def t16(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.array_join(T.watermarks(F.col("text")), ",").alias("hits"))


_FACTS = ["1,000원 까지", "1,000원은", "100만원 (약)", "3억 원을", "₩1,000", "2024년 1월 3일에", "12.5% 오름", "ISSN 1234-567X", "제 12 호", "2024.03 부터", "\\$1,000.50 그리고 $7", "1,234.5 원", "없음"]


@query("T18_entities", sql(rf"""SELECT doc_id, len(list_distinct(list_concat(regexp_extract_all(f, '\d{{4}}\s*년\s*\d{{1,2}}\s*월(?:\s*\d{{1,2}}\s*일)?'), regexp_extract_all(f, '2024\.03')))) AS dates,
  len(list_distinct(list_concat(regexp_extract_all(f, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\s*원(?:[^\p{{L}}\p{{N}}_]|$)'), regexp_extract_all(f, '\d{{1,4}}(?:\.\d+)?\s*(?:만|억|조|천)\s*원(?:[^\p{{L}}\p{{N}}_]|$)'), regexp_extract_all(f, '[$₩]\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?\b')))) AS amounts,
  len(list_distinct(regexp_extract_all(f, '\b\d{{1,3}}(?:\.\d+)?\s*%'))) AS percents, len(list_distinct(list_concat(regexp_extract_all(f, '\bISSN\s+\d{{4}}-\d{{3}}[\dXx]\b'), regexp_extract_all(f, '제\s*\d+\s*호')))) AS identifiers
  FROM (SELECT doc_id, [{", ".join(f"'{x}'" for x in _FACTS)}][(doc_id % {len(_FACTS)} + 1)::INT] AS f FROM docs)"""))
def t18(v: Views) -> DataFrame:
    """Sentences with a fact of every kind, with and without a particle after it."""
    fact = F.get(F.array(*map(F.lit, _FACTS)), (F.col("doc_id") % len(_FACTS)).cast("int"))
    e = T.entities(fact)
    return v.docs().select("doc_id", *[F.size(e[k]).alias(k) for k in ("dates", "amounts", "percents", "identifiers")])


@query("T18_entities_in_texts", sql(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\$\d{1,3}(?:,\d{3})*(?:\.\d+)?\b'))) AS amounts, len(list_distinct(regexp_extract_all(text, '\b\d{1,3}(?:\.\d+)?\s*%'))) AS percents FROM docs"))
def t18b(v: Views) -> DataFrame:
    e = T.entities(F.col("text"))
    return v.docs().select("doc_id", *[F.size(e[k]).alias(k) for k in ("amounts", "percents")])


@query("T17_gate_rollup", sql(r"""SELECT doc_id, bool_or(len(regexp_extract_all(t, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,7}\b')) > 0 OR len(list_filter(regexp_extract_all(t, '\b\d{6}[-\s]?\d{7}\b'), lambda x: x[3:4]::INT BETWEEN 1 AND 12 AND x[5:6]::INT BETWEEN 1 AND 31)) > 0) AS has_pii,
  bool_or(regexp_matches(t, '(?i)대외비|내부자료|보안|CONFIDENTIAL|INTERNAL')) AS has_watermark, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(t, '(?i)대외비|내부자료|보안|CONFIDENTIAL|INTERNAL'))))), ',') AS hits, any_value(doc_id % 9 = 5 AND doc_id % 2 = 0) AS third_party
  FROM (SELECT doc_id, text || CASE WHEN chunk_idx = 0 AND doc_id % 8 = 0 THEN ' 대외비 Confidential' WHEN doc_id % 8 = 1 THEN ' 보안 ' || chunk_idx ELSE '' END || CASE doc_id % 7 WHEN 0 THEN ' 900101-1234567' WHEN 1 THEN ' 901301-1234567' ELSE '' END AS t FROM chunks) GROUP BY doc_id"""))
def t17(v: Views) -> DataFrame:
    i = F.col("doc_id")
    mark = F.when((F.col("chunk_idx") == 0) & (i % 8 == 0), " 대외비 Confidential").when(i % 8 == 1, F.concat(F.lit(" 보안 "), F.col("chunk_idx").cast("string"))).otherwise("")
    number = F.when(i % 7 == 0, " 900101-1234567").when(i % 7 == 1, " 901301-1234567").otherwise("")
    chunks = v.chunks().withColumn("text", F.concat("text", mark, number))
    kinds = v.docs().select("doc_id", F.when((F.col("doc_type") == "image") & (i % 2 == 0), "메신저대화").alias("image_kind"))
    told = chunks.select("doc_id", (F.size(T.pii_ranges(F.col("text"))) > 0).alias("pii"), T.watermarks(F.col("text")).alias("hits"))
    return C.gate(told, kinds).withColumn("hits", F.array_join("hits", ","))


@query("T21_exact_duplicates", sql("SELECT user_id, doc_id, first AS duplicate_of FROM (SELECT user_id, doc_id, min(doc_id) OVER (PARTITION BY user_id, text) AS first FROM docs) WHERE doc_id <> first"))
def t21(v: Views) -> DataFrame:
    return C.exact_duplicates(v.docs())


@query("T23_filename_similarity")
def t23(v: Views) -> DataFrame:
    d = v.docs().select("doc_id", "title")
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    return d.join(other, "doc_id").select("doc_id", F.round(T.name_ratio(F.col("title"), F.col("other")), 6).alias("ratio"))


@query("T24_embedding_source", sql("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN title || chr(10) || user_id ELSE left(text, 3000) END) AS sha FROM docs"))
def t24(v: Views) -> DataFrame:
    summary = F.when(F.col("doc_id") % 2 == 0, F.col("title"))
    return v.docs().select("doc_id", F.sha2(T.embedding_source(summary, F.col("user_id"), F.col("text")).cast("binary"), 256).alias("sha"))


@query("T26_merged_tags", sql("SELECT doc_id, CASE WHEN tags[1] = 'en' THEN 'en,' || tags[2] || ',fr' WHEN tags[1] = 'fr' THEN 'fr,' || tags[2] ELSE tags[1] || ',' || tags[2] || ',fr' END AS tags FROM docs"))
def t26(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.array_join(T.merged_tags(F.col("tags"), F.array(F.lit("fr"))), ",").alias("tags"))


@query("T27_scans", sql("SELECT doc_id FROM docs WHERE length(trim(text, ' ' || chr(9) || chr(13) || chr(10))) <= 50"))
def t27(v: Views) -> DataFrame:
    return v.docs().filter(T.is_scan(F.col("text"))).select("doc_id")


@query("T2_T3_T5_packed_sentences")
def t2(v: Views) -> DataFrame:
    return C.packed(v.docs()).select("doc_id", "idx", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("T6_merged_sections")
def t6(v: Views) -> DataFrame:
    lines = v.docs().select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    sections = lines.select("doc_id", "idx", (F.floor(F.col("idx") / 20) + 1).cast("int").alias("page"), F.lit(None).cast("string").alias("title"), "text")
    return C.merged(sections).select("doc_id", "idx", "page", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("T5_W11_overlap", sql("SELECT chunk_id, sha256(CASE WHEN least(100, 1000 - length(text) - 1) > 0 AND p IS NOT NULL THEN right(p, least(100, 1000 - length(text) - 1)) || ' ' || text ELSE text END) AS sha FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS p FROM chunks)"))
def t5(v: Views) -> DataFrame:
    pieces = v.chunks().select("chunk_id", "doc_id", F.col("chunk_idx").alias("idx"), "text")
    return C.overlapped(pieces).select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


_LINES = ["제 3 조 목적", "1. Introduction", "Abstract", "arXiv:2601.00442v1 [hep-th] 1 Jan 2026", "12", "Page 3", "- 4 -", "【판시사항】", "Chapter 2", "2.1 related", "1. Intro (x)"]
_SIZED = rf"""lined AS (SELECT doc_id, pos, pos // 20 AS page, CASE WHEN pos % 6 = 1 THEN [{", ".join(f"'{x}'" for x in _LINES)}][((doc_id + pos) % {len(_LINES)} + 1)::INT] ELSE raw END AS text, CASE WHEN pos % 9 = 4 THEN 11.5::DOUBLE WHEN pos % 9 = 5 THEN 11.4 ELSE 10 END AS size
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)),
told AS (SELECT l.*, NOT (length(text) <= 80 AND regexp_matches(text, '{T.PAGE_HEADER}')) AND ((median > 0 AND size >= 1.15::DOUBLE * median) OR (length(text) <= 80 AND regexp_matches(text, '{T.HEADING}'))) AS is_heading
  FROM lined l JOIN (SELECT doc_id, page, quantile_cont(size, 0.5) AS median FROM lined GROUP BY 1, 2) m ON m.doc_id = l.doc_id AND m.page = l.page)"""


def _headed(v: Views) -> DataFrame:
    raw = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    sample = F.get(F.array(*map(F.lit, _LINES)), ((F.col("doc_id") + F.col("pos")) % len(_LINES)).cast("int"))
    lines = raw.select("doc_id", "pos", F.floor(F.col("pos") / 20).alias("page"), F.when(F.col("pos") % 6 == 1, sample).otherwise(F.col("raw")).alias("text"), F.when(F.col("pos") % 9 == 4, 11.5).when(F.col("pos") % 9 == 5, 11.4).otherwise(10.0).alias("size"))
    medians = lines.groupBy("doc_id", "page").agg(F.median("size").alias("median"))
    return lines.join(medians, ["doc_id", "page"]).withColumn("is_heading", T.heading(F.col("text"), F.col("size"), F.col("median")))


@query("C5_headings", sql("SELECT doc_id, pos, is_heading FROM told", _SIZED))
def c5(v: Views) -> DataFrame:
    return _headed(v).select("doc_id", "pos", "is_heading")


@query("C6_W12_sticky_headings", sql("SELECT doc_id, pos, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM told", _SIZED))
def c6(v: Views) -> DataFrame:
    return C.sticky_headings(_headed(v)).select("doc_id", "pos", "section")


@query("C18_C20_hash_and_clean", sql("SELECT doc_id, sha256(text) AS sha, strlen(text) AS bytes FROM docs"))
def c18(v: Views) -> DataFrame:
    clean = T.no_nul(F.col("text"))
    return v.docs().select("doc_id", F.sha2(clean.cast("binary"), 256).alias("sha"), F.octet_length(clean).alias("bytes"))


@query("Q1_nfc", sql("SELECT doc_id, sha256(nfc_normalize(text)) AS sha FROM docs"))
def q1(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.sha2(T.nfc(F.col("text")).cast("binary"), 256).alias("sha"))


@query("Q12_Q13_sub_queries", sql("SELECT doc_id, CASE WHEN doc_id % 7 BETWEEN 2 AND 5 THEN doc_id % 7 ELSE 0 END AS n FROM docs"))
def q12(v: Views) -> DataFrame:
    items = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("doc_id") % 7).cast("int"))), lambda i: F.concat(F.lit("q"), i.cast("string")))
    answer = F.concat(F.lit("Sure: "), F.to_json(F.when(F.col("doc_id") % 7 > 0, items).otherwise(F.array(F.lit(" ")))), F.lit(" done"))
    return v.docs().select("doc_id", F.size(Q.sub_queries(answer)).alias("n"))


@query("Q16_Q17_hashes", sql("SELECT query_id, sha256(text) AS hash, sha256(trim(text)) AS key FROM queries"))
def q16(v: Views) -> DataFrame:
    q = v.queries()
    return q.select("query_id", Q.hashed(F.col("text")).alias("hash"), F.sha2(F.trim(T.nfc(F.col("text"))).cast("binary"), 256).alias("key"))


@query("R6_or_terms", sql(r"SELECT query_id, array_to_string(list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda t: regexp_replace(t, '[?!.,;:]+$', '')), lambda t: t <> ''), ' OR ') AS terms FROM queries"))
def r6(v: Views) -> DataFrame:
    from lodestar.operators.retrieval import or_terms

    return v.queries().select("query_id", F.array_join(or_terms("text"), " OR ").alias("terms"))


@query("N5_keywords", sql(r"SELECT doc_id, array_to_string(list(term ORDER BY n DESC, term)[1:5], ',') AS words FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(left(text, 500)), '[\p{L}\p{N}_]+')) AS term FROM docs) WHERE length(term) >= 4 GROUP BY 1, 2) GROUP BY doc_id"))
def n5(v: Views) -> DataFrame:
    from lodestar.operators.retrieval import terms

    counts = v.docs().select("doc_id", F.explode(terms(F.left("text", F.lit(500)))).alias("term")).filter(F.char_length("term") >= 4).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), 1, 5)
    return counts.groupBy("doc_id").agg(F.array_join(F.transform(best, lambda x: x.term), ",").alias("words"))


@query("T35_rechunk_difference", sql("SELECT doc_id, (length(text) + 799) // 800 AS now, (length(text) + 399) // 400 AS new FROM docs"))
def t35(v: Views) -> DataFrame:
    now = v.chunks().groupBy("doc_id").agg(F.count("*").alias("now"))
    new = v.docs().select("doc_id", F.ceil(F.char_length("text") / 400).alias("new"))
    return new.join(now, "doc_id").select("doc_id", "now", "new")
