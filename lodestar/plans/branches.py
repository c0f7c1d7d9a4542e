"""Queries whose inputs, derived from the tables, reach every branch of a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunks, joins, metering, metrics, pages, patterns, retrieval
from lodestar.plans.catalog import query
from lodestar.plans.evaluation import _EVAL, measured
from lodestar.plans.retrieval import _HITS, _live_chunks, hybrid, hydrated, sparse_hits
from lodestar.sources import files, paged, shared
from lodestar.sources.views import AS_OF, MODES, Views, sql

_SUBS = r"""subq AS (SELECT query_id, s AS sub_id, CASE s WHEN 0 THEN array_to_string(w[1:len(w) // 2], ' ') ELSE array_to_string(w[len(w) // 2 + 1:], ' ') END AS text FROM (SELECT query_id, string_split(text, ' ') AS w, unnest([0, 1]) AS s FROM queries WHERE query_id % 3 = 0)),
subask AS (SELECT DISTINCT query_id, sub_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM subq),
subhits AS (SELECT * FROM (SELECT query_id, sub_id, chunk_id, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY count(*) DESC, chunk_id) AS rank FROM tok JOIN subask USING (term) GROUP BY query_id, sub_id, chunk_id) WHERE rank <= 10)"""


@query("R17_sub_queries", sql("""SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 20 AND query_id % 3 = 0 UNION ALL SELECT query_id, chunk_id, rank FROM subhits) GROUP BY 1, 2
UNION ALL SELECT query_id, chunk_id, round(rrf, 9) FROM fused WHERE query_id % 3 <> 0""", _HITS, _SUBS))
def r17(v: Views) -> DataFrame:
    """One query in three has two sub-queries, the halves of its text: its own first 20 and their first 10 each are merged."""
    w, half = F.split("text", " "), F.floor(F.size(F.split("text", " ")) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    subs = v.queries().filter("query_id % 3 = 0").select(F.col("query_id").alias("of"), F.posexplode(parts).alias("sub_id", "text"))
    hits = retrieval.sparse(_live_chunks(v), subs.select((F.col("of") * 2 + F.col("sub_id")).alias("query_id"), "text"), 10)
    hits = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("sub_id"), "chunk_id", "rank")
    return retrieval.decomposed(hybrid(v), hits, subs.select(F.col("of").alias("query_id"))).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("R4_fallback_switch", sql("""SELECT query_id, chunk_id, round(rrf, 9) AS score, false AS fallback FROM fused WHERE query_id % 5 > 1
UNION ALL SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 9), true FROM sparse WHERE query_id % 5 = 0""", _HITS))
def r4(v: Views) -> DataFrame:
    """Of five queries one cannot be embedded for the time being, and one never."""
    failures = v.queries().filter("query_id % 5 <= 1").select("query_id", (F.col("query_id") % 5 == 0).alias("transient"))
    return retrieval.with_fallback(hybrid(v), sparse_hits(v), failures).withColumn("score", F.round("score", 9))


@query("R10_guards_by_path", sql("""SELECT query_id, chunk_id, round(CASE WHEN query_id % 4 <= 1 THEN rrf ELSE rrf * (CASE WHEN length(text) <= 30 AND (chunk_idx = 0 OR page = 1) THEN 0.3::DOUBLE ELSE 1 END) * (CASE WHEN chunk_idx % 6 = 0 THEN 0.3::DOUBLE ELSE 1 END) END, 9) AS score FROM hits""", _HITS))
def r10(v: Views) -> DataFrame:
    """Cover and contents guards, passed over where the reranker's score stands: fresh, cached, degraded and disabled queries."""
    names = F.array(*map(F.lit, ("invoked", "cached", "degraded", "disabled")))
    path = F.get(names, (F.col("query_id") % 4).cast("int"))
    head = F.when(F.col("chunk_idx") % 3 == 0, F.lit("목차 ")).otherwise(F.lit("본문 "))
    section = F.when(F.col("chunk_idx") % 2 == 0, F.lit("(vision) p.1")).otherwise(F.lit("p.1"))
    guarded = retrieval.toc_guard(retrieval.cover_guard(F.col("rrf")), F.concat(head, F.col("text")), section, F.lit("질문"))
    return hydrated(v).select("query_id", "chunk_id", F.round(retrieval.unless_reranked(guarded, F.col("rrf"), path), 9).alias("score"))


@query("R18_rerank_cache", sql("""SELECT query_id, chunk_id, path, round(CASE WHEN rank > 20 THEN rrf WHEN path = 'cached' THEN 1 - rank / 100.0::DOUBLE WHEN path = 'invoked' THEN rank / 100.0::DOUBLE ELSE rrf END, 9) AS rrf
FROM (SELECT *, CASE WHEN query_id % 6 = 0 THEN 'cached' WHEN query_id % 3 = 1 THEN 'degraded' WHEN query_id % 7 = 2 THEN 'failed' ELSE 'invoked' END AS path FROM fused)""", _HITS))
def r18(v: Views) -> DataFrame:
    """Cached answers under the right key, in another order of ids and case of the query; under a key of other ids; degraded and failed calls."""
    with shared.held(hybrid(v), "hits") as hits:
        return shared.saved(_reranked(v, hits), "reranked")


def _reranked(v: Views, hits: DataFrame) -> DataFrame:
    asked = v.queries().select("query_id", "text")
    near = hits.filter("rank <= 20")
    ids = near.groupBy("query_id").agg(F.sort_array(F.collect_list("chunk_id"), asc=False).alias("ids")).join(asked, "query_id")
    other = F.when(F.col("query_id") % 6 == 3, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids"))
    keys = ids.filter("query_id % 3 = 0").select("query_id", retrieval.rerank_key(F.concat(F.lit(" "), F.translate("text", "abcdefgh", "ABCDEFGH")), other).alias("key"))
    cache = near.join(keys, "query_id").select("key", "chunk_id", (1 - F.col("rank") / 100.0).alias("score"))
    scores = near.filter("query_id % 7 <> 2").select("query_id", "chunk_id", (F.col("rank") / 100.0).alias("score"))
    return retrieval.reranked(hits, asked, cache, scores, asked.filter("query_id % 3 = 1")).select("query_id", "chunk_id", "path", F.round("rrf", 9).alias("rrf"))


_SHAPED = r"""shaped AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN regexp_replace(html, '<(/?)article', '<\1main', 'g') WHEN 2 THEN regexp_replace(html, '<(/?)article', '<\1div', 'g') WHEN 3 THEN '<body>' || replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '.', '.<br>') || '</body>' ELSE html END AS html FROM pages),
bodied AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>', 1), ''), nullif(regexp_extract(html, '(?is)<main(?:\s[^>]*)?>(.*?)</main\s*>', 1), ''),
  regexp_replace(regexp_extract(html, '(?is)<body(?:\s[^>]*)?>(.*?)</body\s*>', 1), '(?is)<nav(?:\s[^>]*)?>.*?</nav\s*>|<header(?:\s[^>]*)?>.*?</header\s*>|<footer(?:\s[^>]*)?>.*?</footer\s*>|<aside(?:\s[^>]*)?>.*?</aside\s*>|<form(?:\s[^>]*)?>.*?</form\s*>', chr(10) || chr(10), 'g')) AS b FROM shaped),
plain AS (SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->', '', 'g'), '[ \t\r\n]+', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
  '(?i)</?(?:p|h[1-6]|li|ul|ol|blockquote|div|table|tr|section)(?:\s[^>]*)?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM bodied),
parts AS (SELECT page_id, list_filter(list_transform(string_split_regex(t, '\n *\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS p, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS l FROM plain)"""


@query("C13_main_paragraphs", sql("SELECT page_id, i AS idx, sha256(x) AS sha FROM (SELECT page_id, unnest(q) AS x, unnest(range(0, len(q)))::INT AS i FROM (SELECT page_id, CASE WHEN len(p) <= 1 THEN l ELSE p END AS q FROM parts))", _SHAPED))
def c13(v: Views) -> DataFrame:
    """Paragraphs of every page: by article, by main, by the body without frames, and by lines where there are no blocks."""
    i, page = F.col("page_id") % 4, F.col("html")
    bare = F.concat(F.lit("<body>"), F.replace(F.regexp_replace(page, "<[^>]*>", " "), F.lit("."), F.lit(".<br>")), F.lit("</body>"))
    shaped = F.when(i == 1, F.regexp_replace(page, "<(/?)article", "<$1main")).when(i == 2, F.regexp_replace(page, "<(/?)article", "<$1div")).when(i == 3, bare).otherwise(page)
    rows = v.table("pages").select("page_id", shaped.alias("html"))
    return rows.select("page_id", F.posexplode(T.main_paragraphs(F.col("html"))).alias("idx", "x")).select("page_id", "idx", F.sha2(F.col("x").cast("binary"), 256).alias("sha"))


_MEASURES = ", ".join(f"round(avg({m}), 6) AS {m}, round(min({m}), 6) AS {m}_low, round(max({m}), 6) AS {m}_high, round(stddev_pop({m}), 6) AS {m}_spread" for m in ("recall", "mrr", "ndcg"))


@query("A32_five_groups", sql(f"SELECT qtype, caption, doc_type, GROUPING_ID(qtype, caption, doc_type)::INT AS level, count(*) AS n, {_MEASURES}, count(*) FILTER (recall = 0) AS missed, count(*) FILTER (recall >= 1) AS whole FROM (SELECT *, query_id % 4 AS qtype, query_id % 3 = 0 AS caption, ['pdf','hwp','url'][(query_id % 5 % 3 + 1)::INT] AS doc_type FROM m) GROUP BY GROUPING SETS ((qtype), (caption), (doc_type), (qtype, caption), ())", _EVAL))
def a32(v: Views) -> DataFrame:
    """By query type, caption, document type, query type with caption, and overall, in one pass."""
    kind = F.get(F.array(*map(F.lit, ("pdf", "hwp", "url"))), (F.col("query_id") % 5 % 3).cast("int"))
    rows = measured(v).withColumns({"qtype": F.col("query_id") % 4, "caption": F.col("query_id") % 3 == 0, "doc_type": kind})
    return metrics.summary(rows, ["qtype", "caption", "doc_type"], ["recall", "mrr", "ndcg"])


@query("N1_judged_answers", sql("""SELECT doc_id AS query_id, idx, CASE WHEN k IN (0, 1) AND idx = 1 THEN 1.0::DOUBLE WHEN k IN (0, 1) AND idx = 2 THEN 0.25 WHEN k = 3 AND idx = 2 THEN (doc_id % 10) / 10.0::DOUBLE ELSE 0.0 END AS score,
CASE WHEN k = 2 OR k = 5 THEN 'unparsable' WHEN k = 6 OR (k IN (0, 1) AND idx = 3) OR (k = 3 AND idx <> 2) OR (k = 4 AND idx = 3) THEN 'missing' END AS reason FROM (SELECT doc_id, doc_id % 7 AS k FROM documents), (SELECT unnest([1, 2, 3]) AS idx)"""))
def n1(v: Views) -> DataFrame:
    """Answers fenced and bare, words, partial lists, scores that are no numbers, an object, and none at all."""
    q, k = F.col("doc_id"), F.col("doc_id") % 7
    full = '[{"chunk_idx": 1, "score": 3}, {"chunk_idx": 2, "score": 0.5}, {"chunk_idx": "2", "score": "0.25"}, {"chunk_idx": "x", "score": 1}]'
    part = F.concat(F.lit('[{"chunk_idx": 2, "score": '), ((q % 10) / 10.0).cast("string"), F.lit("}]"))
    answer = F.when(k == 0, f"```json\n{full}\n```").when(k == 1, full).when(k == 2, "I cannot say.").when(k == 3, part).when(k == 4, '[{"chunk_idx": 1, "score": "high"}, {"chunk_idx": 2}]').when(k == 5, '{"chunk_idx": 1, "score": 1}')
    asked = v.table("documents").select(q.alias("query_id"), answer.alias("answer"))
    return pages.judged(asked.filter("answer IS NOT NULL"), asked.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("idx")))


@query("N3_four_reasons", sql("SELECT CASE WHEN doc_id % 7 = 0 THEN 'already_filled' WHEN doc_id % 5 = 0 THEN 'negative' WHEN doc_id % 11 < 2 THEN 'no_doc_id' WHEN doc_id % 3 < 2 THEN 'no_relevant' ELSE 'selected' END AS reason, count(*) AS n FROM documents GROUP BY 1"))
def n3(v: Views) -> DataFrame:
    i = F.col("doc_id")
    reason = pages.skip_reason(
        F.when(i % 7 == 0, F.lit(" 3,4 ")).otherwise(F.lit("  ")),
        F.when(i % 5 == 0, F.lit("True ")).when(i % 2 == 0, F.lit("false")),
        F.when(i % 11 == 0, F.lit(None)).when(i % 11 == 1, F.lit(" ")).otherwise(i.cast("string")),
        F.when(i % 3 == 0, F.lit("x, 1.5")).when(i % 3 == 1, F.lit(None)).otherwise(F.lit("x, 12")),
    )
    return v.table("documents").groupBy(F.coalesce(reason, F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


_FLAGGED = "CASE WHEN doc_id % 2 = 0 THEN 'ingest_mode=fast;' ELSE '' END"


@query("T33_T34_flags", sql(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_FLAGGED} WHEN 1 THEN 'error_msg=' || left(text, 500) || ';failed=true;failed_at={AS_OF};' || {_FLAGGED} || 'pii=true;' ELSE {_FLAGGED} || 'pii=true;' END AS flags,
doc_id % 3 = 2 AND list_contains([0, 1, 2, 3, 4], doc_id % 7) AS vec, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS tags, CASE WHEN doc_id % 3 > 0 THEN lang END AS summary, CASE WHEN doc_id % 3 = 2 THEN coalesce(n, 0) ELSE 0 END AS chunks
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)"""))
def t33(v: Views) -> DataFrame:
    """One document in three is reset, one has failed: chunks, vector, tags, summary and flags of all."""
    i = F.col("doc_id")
    flags = F.map_concat(F.when(i % 2 == 0, F.create_map(F.lit("ingest_mode"), F.lit("fast"))).otherwise(F.create_map().cast("map<string,string>")), F.create_map(F.lit("pii"), F.lit("true")))
    docs = v.table("documents").select("doc_id", F.array("lang", "source").alias("tags"), F.col("lang").alias("summary"), flags.alias("flags"), F.when(i % 7 <= 4, F.array(F.lit(1.0))).alias("vec"))
    again = docs.filter("doc_id % 3 = 0").select("doc_id")
    errors = v.table("documents").filter("doc_id % 3 = 1").select("doc_id", F.col("text").alias("error"))
    kept = v.chunks().join(again.unionByName(errors.select("doc_id")), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    done = pages.failed(pages.reset(docs, again), errors, AS_OF)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("flags")), lambda x: F.concat(x.key, F.lit("="), x.value, F.lit(";"))), "")
    return done.join(kept, "doc_id", "left").select("doc_id", told.alias("flags"), F.col("vec").isNotNull().alias("vec"), F.size("tags").alias("tags"), "summary", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("B16_search_modes", sql("SELECT event_id, ['dense','sparse','hybrid','hybrid','hybrid'][(event_id % 5 + 1)::INT] AS mode FROM events"))
def b16(v: Views) -> DataFrame:
    i = F.col("event_id") % 5
    mode = F.when(i == 0, "dense").when(i == 1, "sparse").when(i == 2, "hybrid").when(i == 3, "Fuzzy")
    return v.table("events").select("event_id", metering.search_mode(mode, MODES).alias("mode"))


@query("Q15_quota_by_error", sql("SELECT event_id, event_id % 6 IN (0, 1, 2, 3) OR (event_id % 6 = 4 AND contains(props, '429')) AS is_quota FROM events"))
def q15(v: Views) -> DataFrame:
    """By name, by code, by two words in the message, by the number in the event's own text, and none."""
    i = F.col("event_id") % 6
    name = F.when(i == 0, "ResourceExhausted").when(i == 5, "ValueError")
    message = F.when(i == 2, "grpc: resource_exhausted, try later").when(i == 3, "daily Quota used").when(i == 4, F.col("props")).when(i == 5, "bad value")
    return v.table("events").select("event_id", metering.is_quota_error(name, F.when(i == 1, 429).when(i == 5, 400), message).alias("is_quota"))


_URLS = ["http://localhost/a", "https://10.1.2.3/", "http://172.16.9.9:80/x", "http://172.32.0.1/", "http://192.168.0.7", "http://169.254.169.254/latest", "ftp://example.com/", "http://[::1]/", "https://8.8.8.8/", "http://127.0.0.1", "http://printer.local/", "http:///none", "https://me@10.0.0.1/"]


@query("C17_url_forms", sql(f"SELECT page_id, k IN (3, 8) OR k >= {len(_URLS)} AS safe FROM (SELECT page_id, page_id % {len(_URLS) + 2} AS k FROM pages)"))
def c17(v: Views) -> DataFrame:
    """Local, private, link-local, named and numbered hosts, another scheme, and the pages' own urls."""
    n = len(_URLS)
    url = F.coalesce(F.get(F.array(*map(F.lit, _URLS)), (F.col("page_id") % (n + 2)).cast("int")), F.col("url"))
    return v.table("pages").select("page_id", files.is_safe_url(url).alias("safe"))


_EXT = [*files.EXTENSIONS, ".exe", "", ".PDF"]


@query("C15_allowed_extensions", sql(f"SELECT doc_id, [{', '.join(f'{x!r}' for x in [*files.EXTENSIONS.values(), None, None, 'pdf'])}][(doc_id % {len(_EXT)} + 1)::INT] AS doc_type FROM documents".replace("None", "NULL")))
def c15(v: Views) -> DataFrame:
    """Every extension that is taken, one in capitals, one that is not, and none."""
    name = F.concat(F.lit("file"), F.get(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT)).cast("int")))
    return v.table("documents").select("doc_id", files.doc_type(name).alias("doc_type"))


@query("R20_R23_from_data", sql("SELECT chunk_id, sha256(lang || chr(10) || CASE chunk_id % 3 WHEN 2 THEN text || ' [검색어: ' || lang || '] end' ELSE c.text END) AS hyde FROM chunks c JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE NOT regexp_matches(c.text, '\\s$')".replace("\\\\", "\\")))
def r20(v: Views) -> DataFrame:
    """Markers of each document's language at the end, which go, and within, which stay; in front the query."""
    rows = v.chunks().join(v.table("documents").select("doc_id", "lang"), "doc_id").filter(~F.col("text").rlike(r"\s$"))
    i = F.col("chunk_id") % 3
    text = F.when(i == 0, F.concat("text", F.lit("\n\n[검색어: "), "lang", F.lit(", x]\n"))).when(i == 2, F.concat("text", F.lit(" [검색어: "), "lang", F.lit("] end"))).otherwise(F.col("text"))
    return rows.select("chunk_id", F.sha2(F.concat_ws("\n", "lang", T.without_synonym_marker(text)).cast("binary"), 256).alias("hyde"))


@query("R22_highlight_ranges", sql("""SELECT chunk_id, CASE WHEN p = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(s)), lambda i: (list_sum(list_transform(s[1:i], lambda x: length(x)))::INT + (i - 1) * 3) || '-' || (list_sum(list_transform(s[1:i], lambda x: length(x)))::INT + i * 3)), ',') END AS ranges
FROM (SELECT chunk_id, p, string_split(lower(CASE WHEN p > 241 THEN '…' ELSE '' END || substr(text, greatest(p - 240, 1), least(p + 242, length(text)) - greatest(p - 241, 0)) || CASE WHEN p + 242 < length(text) THEN '…' ELSE '' END), 'ing') AS s FROM (SELECT chunk_id, text, strpos(lower(text), 'ing') AS p FROM chunks))"""))
def r22(v: Views) -> DataFrame:
    """The ranges of all hits inside each snippet."""
    _, marks = retrieval.snippet(F.col("text"), F.lit("Ing"))
    return v.chunks().select("chunk_id", F.array_join(F.transform(marks, lambda m: F.array_join(m.cast("array<string>"), "-")), ",").alias("ranges"))


@query("T9_records_with_synonyms", sql("""SELECT chunk_id, chunk_idx, sha256(nfc_normalize(text)) AS sha, coalesce(w, '') AS synonyms, (chunk_idx * 800)::INT AS range_start, (chunk_idx * 800 + length(text))::INT AS range_end FROM chunks LEFT JOIN
(SELECT chunk_id, array_to_string(list(word ORDER BY key)[1:5], ',') AS w FROM (SELECT chunk_id, key, word FROM chunks JOIN (SELECT unnest(['ing', 'ou', 'the', 'er']) AS key, unnest(['gerund', 'vowel', 'le', 'ar']) AS word) ON contains(text, key) AND NOT contains(text, word)) GROUP BY chunk_id) USING (chunk_id)"""))
def t9(v: Views) -> DataFrame:
    """Chunk records with their synonyms and their place in the document."""
    pairs = v.spark.createDataFrame([("ing", "gerund"), ("ou", "vowel"), ("the", "le"), ("er", "ar")], "key string, word string")
    rows = patterns.synonyms(v.chunks().withColumn("text", T.nfc(F.col("text"))), pairs, "text", "words")
    start = (F.col("chunk_idx") * 800).cast("int")
    return rows.select("chunk_id", "chunk_idx", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.array_join("words", ",").alias("synonyms"), start.alias("range_start"), (start + F.char_length("text")).alias("range_end"))


@query("C2_C3_paged_source", sql("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id >= 37 AND doc_id < 900 AND lang <> 'fr'"))
def c2(v: Views) -> DataFrame:
    """Documents through the paged source, a range of ids pushed into it."""
    own = v.spark.newSession()  # pushing filters into Python sources is a setting
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(paged.PagedSource)
    rows = own.read.format("paged").option("path", f"{v.dir}/documents.parquet").option("key", "doc_id").option("page", 100).option("columns", "doc_id,lang,n_chars").load()
    return rows.filter("doc_id >= 37 AND doc_id < 900 AND lang <> 'fr'")


@query("M10_grounding_all_chunks", sql(r"SELECT query_id, round(max(CASE WHEN cap <> '' THEN list_cosine_similarity(q.vec, x.vec) END), 6) AS grounding FROM queries q, (SELECT c.doc_id, regexp_extract(whole, '\[표\] (.+)', 1) AS cap, v.vec FROM capt c JOIN vecs v USING (doc_id)) x GROUP BY query_id", r"""capt AS (SELECT c.*, CASE WHEN chunk_idx % 4 = 3 THEN text || chr(10) || chr(10) || '[표] Table ' || page ELSE text END AS whole FROM chunks c)"""))
def m10(v: Views) -> DataFrame:
    """Of every query the greatest cosine with a caption's vector, over all chunks that have one."""
    whole = T.composed(F.col("text"), F.when(F.col("chunk_idx") % 4 == 3, F.concat(F.lit("[표] Table "), F.col("page").cast("string"))))
    captions = v.chunks().select("doc_id", F.regexp_extract(whole, r"\[표\] (.+)", 1).alias("caption")).filter("caption <> ''").select("doc_id").distinct()
    best = retrieval.dense(captions.join(v.vecs(), "doc_id"), v.queries(), 1, "doc_id")
    return v.queries().select("query_id").join(best, "query_id", "left").select("query_id", F.round("sim", 6).alias("grounding"))


@query("C14_routed_to_readers", sql("""SELECT doc_id, doc_type, i AS idx, sha256(x) AS sha, NULL AS skipped FROM (SELECT doc_id, doc_type, unnest(q) AS x, unnest(range(0, len(q)))::INT AS i FROM (SELECT doc_id, doc_type, CASE doc_type
  WHEN 'txt' THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') WHEN 'md' THEN list_filter(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> '')
  ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '') END AS q FROM docs WHERE doc_type IN ('txt', 'md') OR (doc_type = 'url' AND NOT regexp_matches(text, '[<>&]'))))
UNION ALL SELECT doc_id, doc_type, 0, NULL, 'no reader for ' || doc_type FROM docs WHERE doc_type NOT IN ('txt', 'md', 'url')""".replace("\\\\", "\\")))
def c14(v: Views) -> DataFrame:
    """Plain texts by lines, marked-up ones by blank lines, pages by their paragraphs; other types are skipped with a reason."""
    kind, text = F.col("doc_type"), F.col("text")
    page = F.concat(F.lit("<html><body><nav>menu</nav><article><p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    content = F.when(kind == "url", page).when(kind == "md", F.replace(text, F.lit(". "), F.lit(".\n\n"))).otherwise(text)
    items = v.docs().filter((kind != "url") | ~text.rlike("[<>&]")).select("doc_id", "doc_type", content.alias("content"))
    readers = {
        "txt": lambda c: F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""),
        "md": lambda c: F.filter(F.split(c, "\n\n", -1), lambda x: F.trim(x) != ""),
        "url": T.main_paragraphs,
    }
    return chunks.routed(items, readers).select("doc_id", "doc_type", "idx", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "skipped")


@query("C25_mail_attachments", sql(f"""SELECT mail_id, idx, owner, CASE WHEN owner IS NULL THEN 'unknown_token' WHEN ext NOT IN ({', '.join(repr(x) for x in files.EXTENSIONS)}) THEN 'not_allowed' WHEN k > 1 THEN 'duplicate' ELSE 'ingested' END AS status,
  CASE WHEN owner IS NOT NULL AND ext IN ({', '.join(repr(x) for x in files.EXTENSIONS)}) AND k = 1 THEN 'user/' || owner || '/' || sha || ext END AS path
FROM (SELECT *, row_number() OVER (PARTITION BY owner, sha, ext IN ({', '.join(repr(x) for x in files.EXTENSIONS)}) ORDER BY mail_id, idx) AS k FROM (
  SELECT event_id AS mail_id, idx::INT AS idx, c_name AS owner, sha256(props || (idx % 2)) AS sha, ['.pdf', '.exe', '.md'][((event_id + idx) % 3 + 1)::INT] AS ext
  FROM (SELECT *, unnest(range(0, event_id % 4)) AS idx FROM events) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = user_id))"""))
def c25(v: Views) -> DataFrame:
    """Mails with none to three attachments: unknown tokens, names that are not taken, contents seen before, and the rest."""
    i = F.col("event_id")
    ext = F.array(F.lit(".pdf"), F.lit(".exe"), F.lit(".MD"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < i % 4)
    parts = F.transform(numbers, lambda k: F.struct(F.concat(F.lit("a"), F.get(ext, ((i + k) % 3).cast("int"))).alias("name"), F.concat("props", (k % 2).cast("string")).alias("content")))
    mails = v.table("events").select(i.alias("mail_id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), parts.alias("attachments"))
    addresses = v.table("customer").filter("c_custkey % 7 <> 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_name").alias("owner"))
    return joins.mailed(mails, addresses, files.doc_type)
