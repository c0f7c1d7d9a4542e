"""Queries of page work, expansion, judgements and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import queries as Q
from lodestar.functions import text as T
from lodestar.operators import filters, metrics, pages, patterns, retrieval, similarity, telemetry
from lodestar.plans.catalog import query
from lodestar.plans.retrieval import _HITS, hybrid, hydrated
from lodestar.sources.views import Views, sql


@query("J2_J3_L2_filters_after_the_cut", sql("SELECT query_id, doc_id, max(rrf) AS score FROM hits JOIN docs d USING (doc_id) WHERE list_has_all(d.tags, ['en']) AND d.deleted_at IS NULL GROUP BY 1, 2", _HITS))
def j3(v: Views) -> DataFrame:
    docs = filters.tenant(v.docs(), None).filter(filters.has_all("tags", ["en"])).select("doc_id")
    return hydrated(v).join(docs, "doc_id").groupBy("query_id", "doc_id").agg(F.max("rrf").alias("score"))


@query("J11_R12_adjacent_retrieval", sql("SELECT DISTINCT h.query_id, c.chunk_id FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_idx IN (h.chunk_idx - 1, h.chunk_idx + 1) WHERE h.page <= 2 AND c.page <= 2 AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = h.query_id AND x.chunk_id = c.chunk_id)", _HITS))
def j11(v: Views) -> DataFrame:
    return pages.neighbours(hybrid(v), v.chunks(), F.col("page") <= 2)


@query("J14_aliases", sql("SELECT a.alias, d.doc_id FROM (SELECT unnest(['one', 'two', 'none']) AS alias, unnest(['en_src1_1', 'en_src2_2', 'zz']) AS title) a JOIN docs d USING (title)"))
def j14(v: Views) -> DataFrame:
    aliases = v.spark.createDataFrame([("one", "en_src1_1"), ("two", "en_src2_2"), ("none", "zz")], "alias string, title string")
    return v.docs().join(F.broadcast(aliases), "title").select("alias", "doc_id")


@query("J15_N11_page_hints", sql("SELECT d.doc_id, CASE WHEN h IS NULL THEN 'no_hint' WHEN n IS NULL THEN 'page_absent' ELSE 'ok' END AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 END AS h FROM docs) d LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM chunks GROUP BY 1, 2) p ON p.doc_id = d.doc_id AND p.page = d.h"))
def j15(v: Views) -> DataFrame:
    hint = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see p."), (F.col("doc_id") % 7 + 1).cast("string"))).otherwise("see all")
    hinted = v.docs().select("doc_id", F.regexp_extract(hint, r"p\.(\d+)", 1).alias("h")).withColumn("page", F.expr("try_cast(h AS int)"))
    known = v.chunks().groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return hinted.join(known, ["doc_id", "page"], "left").select("doc_id", F.when(F.col("page").isNull(), "no_hint").when(F.col("n").isNull(), "page_absent").otherwise("ok").alias("reason"))


@query("L8_slowest", sql("SELECT doc_id, ratio FROM (SELECT job_id AS doc_id, round(sum(duration_ms) / 60000.0::DOUBLE, 6) AS ratio FROM stage_logs GROUP BY 1) ORDER BY ratio DESC, doc_id LIMIT 10"))
def l8(v: Views) -> DataFrame:
    ms = v.stage_logs().groupBy(F.col("job_id").alias("doc_id")).agg(F.round(F.sum("duration_ms") / 60000, 6).alias("ratio"))
    return ms.orderBy(F.desc("ratio"), "doc_id").limit(10)


@query("R7_T19_synonyms", sql("SELECT query_id, len(list_distinct(list_concat(list_transform(w, lambda x: lower(x)), CASE WHEN list_contains(list_transform(w, lambda x: lower(x)), 'the') THEN ['le', 'der'] ELSE [] END, CASE WHEN list_has_any(list_transform(w, lambda x: lower(x)), ['le', 'der']) THEN ['the'] ELSE [] END))) AS n FROM (SELECT query_id, string_split_regex(trim(text), '\\s+') AS w FROM queries)".replace("\\\\", "\\")))
def r7(v: Views) -> DataFrame:
    synonyms = v.spark.createDataFrame([("the", "le"), ("the", "der")], "a string, b string")
    return pages.expanded(v.queries(), synonyms).select("query_id", F.size("terms").alias("n"))


@query("R11_S4_entity_boost", sql("SELECT chunk_id, CASE WHEN page IN (1, 3) THEN 1.1::DOUBLE ELSE 1.0 END AS score FROM chunks"))
def r11(v: Views) -> DataFrame:
    mine, asked = F.array(F.concat(F.lit("p"), F.col("page").cast("string"))), F.array(F.lit("p1"), F.lit("p3"))
    return v.chunks().select("chunk_id", retrieval.entity_boost(F.lit(1.0), mine, asked).alias("score"))


@query("R19_degrade_switch", sql("SELECT count(*) >= 5000 * 0.8 AS degraded FROM usage WHERE called_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"))
def r19(v: Views) -> DataFrame:
    since = F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=F.lit(30))
    return v.usage().filter(F.col("called_at") >= since).agg((F.count("*") >= 5000 * 0.8).alias("degraded"))


@query("R20_R23_inputs", sql("SELECT chunk_id, sha256('q' || chr(10) || text) AS hyde FROM chunks"))
def r20(v: Views) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit("\n\n[검색어: a, b]"))
    return v.chunks().select("chunk_id", F.sha2(F.concat_ws("\n", F.lit("q"), F.when(F.col("text").rlike(r"\n$"), F.col("text")).otherwise(T.without_synonym_marker(marked))).cast("binary"), 256).alias("hyde"))


@query("T14_backfill", sql("SELECT doc_id, 'new' AS flag FROM docs WHERE doc_id % 4 = 0"))
def t14(v: Views) -> DataFrame:
    old = v.docs().select("doc_id", F.when(F.col("doc_id") % 2 == 0, "old").alias("flag"))
    new = v.docs().select("doc_id", F.when(F.col("doc_id") % 4 == 0, "new").when(F.col("doc_id") % 2 == 0, "old").alias("flag"))
    return pages.changed(old, new, "doc_id", "flag")


@query("T25_missing_vectors", sql("SELECT c.chunk_id FROM chunks c LEFT JOIN vecs v USING (doc_id) WHERE v.vec IS NULL"))
def t25(v: Views) -> DataFrame:
    return v.chunks().join(v.vecs().filter("vec IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select("chunk_id")


_PAGES = r"""lines AS (SELECT chunk_id, unnest(string_split(t, chr(10))) AS line FROM (SELECT chunk_id, text || CASE WHEN chunk_idx % 4 = 0 THEN chr(10) || '표 3 요약' ELSE '' END || CASE WHEN chunk_idx % 3 = 0 THEN chr(10) || 'a  b   c' ELSE '' END AS t FROM chunks)),
told AS (SELECT chunk_id, avg(CASE WHEN len(string_split_regex(trim(line), '\s{2,}|\t')) >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS tab, avg(CASE WHEN length(line) <= 80 AND regexp_matches(line, '(?i)^\s*(그림|표|figure|fig\.|table)\s*\d+') THEN 1.0::DOUBLE ELSE 0 END) AS cap FROM lines GROUP BY chunk_id),
sig AS (SELECT chunk_id, 1 - length(text) / 800.0::DOUBLE AS density, tab, (chunk_idx % 5) / 10.0::DOUBLE AS image, 1 - coalesce(length(regexp_replace(text, '[^\p{L}\p{N}.,;:!?''"()\[\]%&+\-/]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0) AS bad, cap FROM chunks JOIN told USING (chunk_id))"""


def _page_signals(v: Views) -> DataFrame:
    """Signals of every chunk as of a page; the area of pictures, which texts do not tell, by the chunk's number."""
    i = F.col("chunk_idx")
    text = F.concat("text", F.when(i % 4 == 0, "\n표 3 요약").otherwise(""), F.when(i % 3 == 0, "\na  b   c").otherwise(""))
    told = pages.signals(v.chunks().select("chunk_id", F.explode(F.split(text, "\n", -1)).alias("line")))
    return v.chunks().join(told, "chunk_id").select("chunk_id", (1 - F.char_length("text") / 800).alias("density"), "table_like", ((i % 5) / 10).alias("image"), (1 - pages.text_quality(F.col("text"))).alias("bad"), "caption")


@query("T28_page_need", sql("SELECT chunk_id, round(0.3 * density + 0.25 * tab + 0.2 * image + 0.1 * bad + 0.15 * cap, 6) AS score, density >= 0.5 OR tab >= 0.5 OR image >= 0.3 OR bad >= 0.6 OR cap >= 0.2 AS needed FROM sig", _PAGES))
def t28(v: Views) -> DataFrame:
    score, needed = pages.need_score(*map(F.col, ("density", "table_like", "image", "bad", "caption")))
    return _page_signals(v).select("chunk_id", F.round(score, 6).alias("score"), needed)


@query("N22_equal_weights", sql("SELECT chunk_id, round((density + tab + image) / 3, 6) AS score FROM sig", _PAGES))
def n22(v: Views) -> DataFrame:
    three = [pages.clamped(F.col(c)) for c in ("density", "table_like", "image")]
    return _page_signals(v).select("chunk_id", F.round((three[0] + three[1] + three[2]) / 3, 6).alias("score"))


_SIGNALS = ["density", "table_like", "image", "bad", "caption"]


@query("A37_signal_percentiles", sql("SELECT doc_id, signal, round(quantile_cont(x, 0.1), 9) AS p10, round(quantile_cont(x, 0.5), 9) AS p50, round(quantile_cont(x, 0.9), 9) AS p90, round(max(x), 9) AS top FROM (SELECT chunk_id // 1000000 AS doc_id, unnest(['density', 'table_like', 'image', 'bad', 'caption', 'weighted', 'equal']) AS signal, unnest([density, tab, image, bad, cap, 0.3 * density + 0.25 * tab + 0.2 * image + 0.1 * bad + 0.15 * cap, (density + tab + image) / 3]) AS x FROM sig) GROUP BY 1, 2", _PAGES))
def a37(v: Views) -> DataFrame:
    score, _ = pages.need_score(*map(F.col, _SIGNALS))
    rows = _page_signals(v).select(F.floor(F.col("chunk_id") / 1_000_000).alias("doc_id"), *_SIGNALS, score.alias("weighted"), ((F.col("density") + F.col("table_like") + F.col("image")) / 3).alias("equal"))
    each = rows.unpivot("doc_id", [*_SIGNALS, "weighted", "equal"], "signal", "x")
    at = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = each.groupBy("doc_id", "signal").agg(at.alias("p"), F.round(F.max("x"), 9).alias("top"))
    return out.select("doc_id", "signal", *[F.round(F.get("p", F.lit(i)), 9).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "top")


@query("A38_correlation_matrix", sql("SELECT a, b, r FROM (SELECT unnest(['density', 'density', 'density', 'density', 'table_like', 'table_like', 'table_like', 'image', 'image', 'bad']) AS a, unnest(['table_like', 'image', 'bad', 'caption', 'image', 'bad', 'caption', 'bad', 'caption', 'caption']) AS b, unnest([corr(d, tab), corr(d, image), corr(d, bad), corr(d, cap), corr(tab, image), corr(tab, bad), corr(tab, cap), corr(image, bad), corr(image, cap), corr(bad, cap)]) AS x, round(x, 6) AS r FROM (SELECT *, -density AS d FROM sig))", _PAGES))
def a38(v: Views) -> DataFrame:
    """Every pair of signals in one pass; the density counts with its sign turned."""
    return pages.correlations(_page_signals(v).withColumn("density", -F.col("density")), _SIGNALS)


@query("M18_threshold_ablation", sql("SELECT signal, t AS threshold, count(*) FILTER (CASE WHEN signal = 'density' THEN density >= t ELSE density >= 0.5 END OR CASE WHEN signal = 'table_like' THEN tab >= t ELSE tab >= 0.5 END OR CASE WHEN signal = 'image' THEN image >= t ELSE image >= 0.3 END OR CASE WHEN signal = 'bad' THEN bad >= t ELSE bad >= 0.6 END OR CASE WHEN signal = 'caption' THEN cap >= t ELSE cap >= 0.2 END) AS needed FROM sig, (SELECT unnest(['density', 'table_like', 'image', 'bad', 'caption']) AS signal), (SELECT unnest([0.15, 0.35, 0.55, 0.75]::DOUBLE[]) AS t) GROUP BY 1, 2", _PAGES))
def m18(v: Views) -> DataFrame:
    """How many pages the OR rule picks as one trigger moves and the others stay."""
    return pages.ablated(_page_signals(v), dict(zip(_SIGNALS, pages.TRIGGERS.values())), [0.15, 0.35, 0.55, 0.75])


@query("T30_line_tests", sql(r"SELECT chunk_id, count(*) FILTER (len(string_split_regex(trim(line), '\s{2,}|\t')) >= 3) AS columns, count(*) FILTER (length(line) <= 80 AND regexp_matches(line, '(?i)^\s*(그림|표|figure|fig\.|table)\s*\d+')) AS captions FROM lines GROUP BY chunk_id", _PAGES))
def t30(v: Views) -> DataFrame:
    i = F.col("chunk_idx")
    text = F.concat("text", F.when(i % 4 == 0, "\n표 3 요약").otherwise(""), F.when(i % 3 == 0, "\na  b   c").otherwise(""))
    lines = v.chunks().select("chunk_id", F.explode(F.split(text, "\n", -1)).alias("line"))
    return lines.groupBy("chunk_id").agg(F.count_if(pages.is_multi_column(F.col("line"))).alias("columns"), F.count_if(pages.is_caption(F.col("line"))).alias("captions"))


@query("T22_dedup_tiers")
def t22(v: Views) -> DataFrame:
    """The most similar other document of an owner, its tier by similarity and by likeness of names."""
    rows = v.vecs().join(v.docs().select("doc_id", "user_id", "title"), "doc_id")
    near = similarity.nearest(rows, "user_id", at_least=0.85)
    names = v.docs().select("doc_id", "title")
    both = near.join(names.withColumnsRenamed({"doc_id": "id", "title": "a"}), "id").join(names.withColumnsRenamed({"doc_id": "of", "title": "b"}), "of")
    return both.select("id", "of", "sim", retrieval.dedup_tier(F.col("sim"), T.name_ratio(F.col("a"), F.col("b"))).alias("tier"))


@query("T29_column_clusters", sql("SELECT page, count(*) FILTER (new) AS columns FROM (SELECT page, coalesce(x - lag(x) OVER (PARTITION BY page ORDER BY x) > 4, true) AS new FROM (SELECT DISTINCT doc_id % 50 AS page, (doc_id * 37 % 200)::DOUBLE AS x FROM docs)) GROUP BY page"))
def t29(v: Views) -> DataFrame:
    from lodestar.operators.chunks import columns_of_page

    return columns_of_page(v.docs().select((F.col("doc_id") % 50).alias("page"), (F.col("doc_id") * 37 % 200).cast("double").alias("x")))


@query("T30_T31_line_tests", sql(r"""SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^\p{L}\p{N}.,;:!?''"()\[\]%&+\-/]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0), 6) AS quality FROM docs"""))
def t31(v: Views) -> DataFrame:
    return v.docs().select("doc_id", F.round(pages.text_quality(F.col("text")), 6).alias("quality"))


@query("T32_W13_incremental_pages", sql("SELECT d.doc_id, d.page, coalesce(m, -1) + row_number() OVER (PARTITION BY d.doc_id ORDER BY d.page) AS new_idx FROM (SELECT doc_id, unnest(range(1, 8)) AS page FROM docs WHERE doc_id % 2 = 0) d LEFT JOIN (SELECT doc_id, max(chunk_idx) AS m FROM chunks GROUP BY 1) l ON l.doc_id = d.doc_id WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = d.doc_id AND c.page = d.page)"))
def t32(v: Views) -> DataFrame:
    wanted = v.docs().filter("doc_id % 2 = 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return pages.missing_pages(wanted, v.chunks())


@query("T33_T34_reset", sql("SELECT doc_id, CASE WHEN failed THEN NULL ELSE n END AS n FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)"))
def t33(v: Views) -> DataFrame:
    left = v.chunks().join(v.docs().filter("failed").select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
    return v.docs().select("doc_id").join(left, "doc_id", "left")


@query("M9_embedding_precision", sql("SELECT query_id, round(sum(greatest(0, sim) / log2(rank + 1)) / sum(1 / log2(rank + 1)), 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM dsim) WHERE rank <= 10 GROUP BY query_id", _HITS))
def m9(v: Views) -> DataFrame:
    top = retrieval.dense(v.vecs(), v.queries(), 10, "doc_id")
    w = 1 / F.log2(F.col("rank") + 1.0)
    return top.groupBy("query_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("sim")) * w) / F.sum(w), 6).alias("precision"))


_GOLD = "ranked AS (SELECT query_id, doc_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM dsim), top AS (SELECT r.*, len(list_filter(['heit', 'tion', 'ciónue'], lambda w: contains(d.text, w))) >= 1 AS hit FROM ranked r JOIN docs d USING (doc_id) WHERE rank <= 5)"


@query("M12_golden_labels", sql("SELECT r.query_id, r.doc_id, CASE WHEN t.relevant THEN 'relevant' ELSE 'acceptable' END AS label FROM ranked r LEFT JOIN (SELECT *, hit OR (rank = 1 AND NOT bool_or(hit) OVER (PARTITION BY query_id)) AS relevant FROM top) t ON t.query_id = r.query_id AND t.doc_id = r.doc_id WHERE (t.relevant OR (r.sim >= 0.25 AND r.rank <= 50)) AND r.doc_id IN (SELECT doc_id FROM docs)", _HITS, _GOLD))
def m12(v: Views) -> DataFrame:
    """Of the five nearest documents those with a wanted word, else the first; acceptable are others near enough."""
    near = retrieval.dense(v.vecs(), v.queries(), 50, "doc_id")
    return metrics.golden(near, v.docs().select("doc_id", "text"), ["heit", "tion", "ciónue"], 5, 0.25).select("query_id", "doc_id", "label")


@query("N4_candidates", sql("SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT forced, CASE WHEN forced THEN doc_id ELSE rank END) AS place FROM (SELECT coalesce(f.query_id, r.query_id) AS query_id, coalesce(f.doc_id, r.doc_id) AS doc_id, f.doc_id IS NOT NULL AS forced, r.rank FROM (SELECT DISTINCT f.* FROM (SELECT query_id, unnest([query_id % 90, (query_id + 7) % 90, -1]) AS doc_id FROM queries) f JOIN docs d USING (doc_id)) f FULL JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.query_id = f.query_id AND r.doc_id = f.doc_id)", _HITS, _GOLD))
def n4(v: Views) -> DataFrame:
    """Relevant documents that exist come first, by id, then the nearest ones; each once."""
    q = F.col("query_id")
    relevant = v.queries().select("query_id", F.explode(F.array(q % 90, (q + 7) % 90, F.lit(-1))).alias("doc_id"))
    known = relevant.join(v.docs().select("doc_id"), "doc_id", "left_semi").distinct()
    return metrics.candidates(known, retrieval.dense(v.vecs(), v.queries(), 5, "doc_id"))


_CAPTIONED = r"""capt AS (SELECT c.*, CASE WHEN chunk_idx % 4 = 0 THEN text || chr(10) || chr(10) || '[표] Table ' || (page + 2) || ' caption of ' || left(text, 20) ELSE text END AS whole FROM chunks c)"""


def _captioned(v: Views) -> DataFrame:
    """Chunks whose text has a caption at its end, one in four."""
    caption = F.concat(F.lit("[표] Table "), (F.col("page") + 2).cast("string"), F.lit(" caption of "), F.left("text", F.lit(20)))
    return v.chunks().withColumn("whole", T.composed(F.col("text"), F.when(F.col("chunk_idx") % 4 == 0, caption)))


@query("M14_caption_dependence", sql("SELECT g.query_id, g.query_id % 7 = 0 OR bool_or(contains(whole, '[표]')) AS marked FROM (SELECT item_id AS query_id, unnest([item_id * 3 % 180, item_id * 5 % 180]) AS doc_id, item_id % 5 AS chunk_idx FROM benchmark) g JOIN capt USING (doc_id, chunk_idx) GROUP BY g.query_id", _CAPTIONED))
def m14(v: Views) -> DataFrame:
    """Queries whose kind needs captions, or one of whose relevant chunks has one."""
    q = F.col("item_id")
    relevant = v.table("benchmark").select(q.alias("query_id"), F.explode(F.array(q * 3 % 180, q * 5 % 180)).alias("doc_id"), (q % 5).alias("chunk_idx"))
    rows = relevant.join(_captioned(v), ["doc_id", "chunk_idx"])
    return rows.groupBy("query_id").agg(((F.col("query_id") % 7 == 0) | F.bool_or(F.contains("whole", F.lit("[표]")))).alias("marked"))


@query("M15_N20_stratified", sql("""SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 10007, doc_id) AS k FROM documents) JOIN (
  SELECT lang, q - CASE WHEN can AND place <= abs(over) THEN sign(over) ELSE 0 END AS quota FROM (SELECT *, sum(can::INT) OVER (ORDER BY n DESC, lang) AS place FROM (SELECT *, CASE WHEN over > 0 THEN q > 1 ELSE q < n END AS can FROM (
    SELECT *, (sum(q) OVER () - 50)::INT AS over FROM (SELECT lang, count(*) AS n, greatest(1, round_even(50 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 0)::INT) AS q FROM documents GROUP BY lang))))) USING (lang) WHERE k <= quota"""))
def m15(v: Views) -> DataFrame:
    draw = F.col("doc_id") * 7919 % 10007
    return pages.stratified(v.table("documents").select("doc_id", "lang"), "lang", draw, 10007, "doc_id", 50).select("doc_id")


@query("N24_last_evaluation", sql("""SELECT a.doc_id AS ask, c.score FROM (SELECT doc_id, lang AS query, CASE WHEN doc_id % 3 > 0 THEN source END AS doc FROM documents) a
  LEFT JOIN (SELECT lang AS query, CASE WHEN doc_id % 2 = 0 THEN source END AS doc, arg_max(n_chars, doc_id) AS score FROM documents WHERE doc_id % 5 < 3 AND lang <> 'es' GROUP BY 1, 2) c ON c.query = a.query AND c.doc IS NOT DISTINCT FROM a.doc"""))
def n24(v: Views) -> DataFrame:
    """Every document asks for the last evaluation of its language, of its source or of none."""
    d = v.table("documents")
    asked = d.select(F.col("doc_id").alias("ask"), F.col("lang").alias("query"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("doc_id"))
    kept = d.filter("doc_id % 5 < 3 AND lang <> 'es'")
    cache = kept.select(F.col("lang").alias("query"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("doc_id"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("score"))
    return pages.last_evaluation(asked, cache).select("ask", "score")


@query("N17_reingest_gate", sql("SELECT source, CASE WHEN abs(after - before) / greatest(before, 1)::DOUBLE * 100 > 5 THEN 'chunks' WHEN nulls > 0 THEN 'null_vectors' WHEN 0.6::DOUBLE - recall > 0.1 THEN 'recall' END AS failed FROM (SELECT source, count(*) AS before, count(*) FILTER (doc_id % 17 <> 0 OR source > 'src5') AS after, count(*) FILTER (doc_id % 13 = 0 AND source < 'src3') AS nulls, avg(CASE WHEN n_chars % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM documents GROUP BY source)"))
def n17(v: Views) -> DataFrame:
    d = v.table("documents")
    numbers = d.groupBy("source").agg(F.count("*").alias("before"), F.count_if((F.col("doc_id") % 17 != 0) | (F.col("source") > "src5")).alias("after"), F.count_if((F.col("doc_id") % 13 == 0) & (F.col("source") < "src3")).alias("null_vectors"), F.avg((F.col("n_chars") % 2 == 0).cast("double")).alias("recall"))
    return pages.gate(numbers, 5.0, 0.6, 0.1).select("source", "failed")


@query("M19_determinism", sql("SELECT count(*) AS n, count(*) FILTER (s < 0.99999) AS unlike, round(min(s), 5) AS least FROM (SELECT list_cosine_similarity(vec, list_transform(vec, lambda x: CASE WHEN doc_id % 10 = 3 THEN round(x, 1) ELSE round(x, 4) END)) AS s FROM vecs)"))
def m19(v: Views) -> DataFrame:
    """Two runs of one embedding: the second is rounded, one in ten coarsely."""
    again = F.transform("vec", lambda x: F.when(F.col("doc_id") % 10 == 3, F.round(x, 1)).otherwise(F.round(x, 4)))
    like = v.vecs().withColumn("again", again).select(retrieval.cosine("vec", "again").alias("s"))
    return like.agg(F.count("*").alias("n"), F.count_if(F.col("s") < 0.99999).alias("unlike"), F.round(F.min("s"), 5).alias("least"))


@query("N1_judgements", sql("SELECT item_id AS query_id, idx, CASE WHEN idx = 1 THEN 1.0::DOUBLE WHEN idx = 2 THEN 0.25 ELSE 0.0 END AS score FROM benchmark, (SELECT unnest([1, 2, 3]) AS idx)"))
def n1(v: Views) -> DataFrame:
    q = v.table("benchmark").select(F.col("item_id").alias("query_id"))
    answers = q.withColumn("answer", F.lit('```json\n[{"idx": 1, "score": 3}, {"idx": 2, "score": 0.5}, {"idx": 2, "score": 0.25}]\n```'))
    return pages.parsed_judgement(answers, q.withColumn("idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))))


@query("N6_anchor_neighbours", sql("SELECT a.doc_id, b.doc_id AS near FROM vecs a JOIN embeddings ea ON ea.vec_id = a.doc_id JOIN embeddings eb ON eb.label = ea.label JOIN vecs b ON b.doc_id = eb.vec_id WHERE a.doc_id % 20 = 0 AND b.doc_id <> a.doc_id AND round(list_cosine_similarity(a.vec, b.vec), 9) >= 0.2"))
def n6(v: Views) -> DataFrame:
    """Anchors are every row whose id is divisible by 20: a stated query set against all rows."""
    rows = v.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    anchors = rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.above(rows, anchors, 0.2, "label").select(F.col("query_id").alias("doc_id"), F.col("id").alias("near"))


@query("N15_cache_by_hash", sql("SELECT d.doc_id, c.version FROM docs d JOIN (SELECT sha256(text) AS sha, max(doc_id % 3) AS version FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) c ON c.sha = sha256(d.text)"))
def n15(v: Views) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    cache = v.table("documents").filter("doc_id % 2 = 0").groupBy(sha).agg(F.max(F.col("doc_id") % 3).alias("version"))
    return v.docs().select("doc_id", sha).join(cache, "sha").select("doc_id", "version")


@query("N19_prefix_count", sql("SELECT count(*) AS n FROM docs WHERE title LIKE 'en\\_%' ESCAPE '\\'"))
def n19(v: Views) -> DataFrame:
    return v.docs().filter(F.startswith("title", F.lit("en_"))).agg(F.count("*").alias("n"))


@query("B12_stage_durations", sql("SELECT job_id, stage, status, duration_ms FROM (SELECT log_id % 100000 AS job_id, stage, status, duration_ms FROM stage_logs WHERE log_id % 9 < 7) UNION ALL SELECT log_id % 100000, stage, 'running', NULL FROM stage_logs WHERE log_id % 9 >= 7"))
def b12(v: Views) -> DataFrame:
    """A row as a stage starts and one as it ends, paired by the run's log id; some stages have not ended."""
    logs = v.stage_logs()
    at = F.unix_millis(F.col("started_at").cast("timestamp"))
    run = ["log_id", (F.col("log_id") % 100_000).alias("job_id"), "stage"]
    started = logs.select(*run, F.lit("started").alias("status"), at.alias("at"))
    ended = logs.filter("log_id % 9 < 7").select(*run, "status", (at + F.col("duration_ms")).alias("at"))
    return telemetry.stage_durations(started.unionByName(ended)).drop("log_id")


@query("L4_L5_rank_caps", sql("SELECT query_id, count(*) FILTER (rank <= 20) AS first, count(*) FILTER (rank <= 10) AS second FROM fused GROUP BY query_id", _HITS))
def l4(v: Views) -> DataFrame:
    return hybrid(v).groupBy("query_id").agg(F.count_if(F.col("rank") <= 20).alias("first"), F.count_if(F.col("rank") <= 10).alias("second"))


@query("F12_owner_view", sql("SELECT user_id, count(*) AS n FROM docs WHERE user_id = 'src1' AND deleted_at IS NULL GROUP BY user_id"))
def f12(v: Views) -> DataFrame:
    return filters.tenant(v.docs(), "src1").groupBy("user_id").agg(F.count("*").alias("n"))


@query("W3_sparse_rank_column", sql("SELECT query_id, chunk_id, rank AS sparse_rank FROM sparse WHERE rank <= 3", _HITS))
def w3(v: Views) -> DataFrame:
    from lodestar.plans.retrieval import sparse_hits

    return sparse_hits(v).filter("rank <= 3").select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))


@query("C13_page_blocks", sql(r"""SELECT page_id, i AS idx, sha256(t) AS sha FROM (SELECT page_id, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (
  SELECT page_id, list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:p|h[1-6]|li|ul|ol|blockquote)\b[^>]*>'), lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages))"""))
def c13(v: Views) -> DataFrame:
    """The blocks of every page's article, in order, without markup."""
    blocks = T.article_blocks(F.col("html"))
    return v.table("pages").select("page_id", F.posexplode(blocks).alias("idx", "t")).select("page_id", "idx", F.sha2(F.col("t").cast("binary"), 256).alias("sha"))


@query("C14_format_router", sql("SELECT CASE WHEN doc_type IN ('docx', 'pptx', 'hwpx') THEN 'zip' WHEN doc_type IN ('txt', 'md', 'url') THEN 'text' WHEN doc_type = 'image' THEN 'model' ELSE 'skipped' END AS route, count(*) AS n FROM docs GROUP BY 1"))
def c14(v: Views) -> DataFrame:
    kind = F.col("doc_type")
    route = F.when(kind.isin("docx", "pptx", "hwpx"), "zip").when(kind.isin("txt", "md", "url"), "text").when(kind == "image", "model").otherwise("skipped")
    return v.docs().groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("W7_chunk_order", sql("SELECT doc_id, array_to_string(list(chunk_idx ORDER BY length(text) DESC, chunk_idx), ',') AS by_size FROM chunks GROUP BY doc_id"))
def w7(v: Views) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct((-F.char_length("text")).alias("s"), "chunk_idx")))
    return v.chunks().groupBy("doc_id").agg(F.array_join(F.transform(packed, lambda x: x.chunk_idx.cast("string")), ",").alias("by_size"))


@query("C1_C2_pruned_scan", sql("SELECT doc_id, lang FROM documents"))
def c1(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "lang")


@query("C17_safe_urls", sql("SELECT page_id, regexp_matches(url, '^https?://[^/]+') AND NOT regexp_matches(url, '^https?://(localhost|10[.]|127[.]|192[.]168[.])') AS safe FROM pages"))
def c17(v: Views) -> DataFrame:
    from lodestar.sources.files import is_safe_url

    return v.table("pages").select("page_id", is_safe_url(F.col("url")).alias("safe"))


@query("C25_mail_to_owner", sql("SELECT e.event_id, c.c_name AS owner FROM events e JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 7 <> 0"))
def c25(v: Views) -> DataFrame:
    tokens = v.table("customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner"))
    return v.table("events").join(tokens, "user_id").select("event_id", "owner")


@query("J16_embedded_join", sql("SELECT c.chunk_id, d.title FROM chunks c JOIN docs d USING (doc_id) WHERE d.user_id = 'src2'"))
def j16(v: Views) -> DataFrame:
    return v.chunks().join(v.docs().filter("user_id = 'src2'").select("doc_id", "title"), "doc_id").select("chunk_id", "title")


@query("L9_group_order", sql("SELECT mode, hit, row_number() OVER (ORDER BY hit DESC, mode) AS place FROM (SELECT mode, round(avg(CASE WHEN fused > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM search_log GROUP BY mode)"))
def l9(v: Views) -> DataFrame:
    rates = v.search_log().groupBy("mode").agg(F.round(F.avg((F.col("fused") > 50).cast("double")), 6).alias("hit"))
    return rates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hit"), "mode")))  # three rows


@query("R4_sparse_fallback", sql("SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM sparse", _HITS))
def r4(v: Views) -> DataFrame:
    from lodestar.plans.retrieval import sparse_hits

    return sparse_hits(v).select("query_id", "chunk_id", F.round(1.0 / (retrieval.RRF_K + F.col("rank")), 9).alias("score"))


@query("R9_R10_toc_guard", sql("SELECT chunk_id, CASE WHEN chunk_idx % 3 = 0 AND chunk_idx % 2 = 0 THEN 0.3::DOUBLE ELSE 1.0 END AS score FROM chunks"))
def r9(v: Views) -> DataFrame:
    head = F.when(F.col("chunk_idx") % 3 == 0, F.lit("목차 ")).otherwise(F.lit("본문 "))
    section = F.when(F.col("chunk_idx") % 2 == 0, F.lit("(vision) p.1")).otherwise(F.lit("p.1"))
    return v.chunks().select("chunk_id", retrieval.toc_guard(F.lit(1.0), F.concat(head, F.lit("x")), section, F.lit("질문")).alias("score"))


@query("T9_chunk_records", sql("SELECT chunk_id, chunk_idx, sha256(nfc_normalize(text)) AS sha, len(list_distinct(regexp_extract_all(text, '\\b\\d{1,3}(?:\\.\\d+)?\\s*%'))) AS percents, 0 AS range_start, length(text) AS range_end FROM chunks".replace("\\\\", "\\")))
def t9(v: Views) -> DataFrame:
    clean = T.nfc(F.col("text"))
    rows = v.chunks().select("chunk_id", "chunk_idx", clean.alias("text"))
    return rows.select("chunk_id", "chunk_idx", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.size(T.entities(F.col("text"))["percents"]).alias("percents"), F.lit(0).alias("range_start"), F.char_length("text").alias("range_end"))


_SYN = "syn AS (SELECT unnest(['ing', 'ou', 'the', 'schen', 'zz', 'er', 'an', 'in']) AS key, unnest(['gerund', 'vowel', 'le', 'diminutive', 'none', 'ar', 'on', 'en']) AS word)"


@query("T20_synonym_candidates", sql("SELECT c.chunk_id, sha256(CASE WHEN w IS NULL THEN text ELSE text || chr(10) || chr(10) || '[검색어: ' || array_to_string(w, ', ') || ']' END) AS sha, coalesce(len(w), 0) AS n FROM chunks c LEFT JOIN (SELECT chunk_id, list(word ORDER BY key)[1:5] AS w FROM (SELECT chunk_id, key, word FROM chunks JOIN syn ON contains(text, key) AND NOT contains(text, word)) GROUP BY chunk_id) x ON x.chunk_id = c.chunk_id", _SYN))
def t20(v: Views) -> DataFrame:
    """Words whose dictionary key a chunk has and that it lacks itself, at most five, as a marker at its end."""
    pairs = [("ing", "gerund"), ("ou", "vowel"), ("the", "le"), ("schen", "diminutive"), ("zz", "none"), ("er", "ar"), ("an", "on"), ("in", "en")]
    rows = patterns.synonyms(v.chunks(), v.spark.createDataFrame(pairs, "key string, word string"), "text", "added")
    return rows.select("chunk_id", F.sha2(T.with_synonym_marker(F.col("text"), F.col("added")).cast("binary"), 256).alias("sha"), F.size("added").alias("n"))


@query("T20_phrases_in_documents", sql("SELECT doc_id, count(*) AS n, min(key) AS first, max(key) AS last FROM documents JOIN (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS key FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark))) ON contains(text, key) GROUP BY doc_id"))
def t20_phrases(v: Views) -> DataFrame:
    """All two-word phrases of all benchmark items in all documents: thousands of keys, one scan of each text."""
    w = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    keys = v.table("benchmark").filter(F.size(w) > 1).select(F.explode(pairs).alias("key"))
    found = patterns.contained(v.table("documents"), keys, "doc_id", F.col("text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


_HINTS = "hints AS (SELECT doc_id AS hint_id, 'see ' || CASE doc_id % 4 WHEN 3 THEN 'nothing' ELSE title END || ' and p.' || (doc_id % 7 + 1) AS text, doc_id % 7 + 1 AS page FROM docs)"


@query("J15_titles_in_hints", sql("SELECT h.hint_id, h.doc_id, CASE WHEN h.doc_id IS NULL THEN 'no_title' WHEN n IS NULL THEN 'page_absent' ELSE 'ok' END AS reason FROM (SELECT h.hint_id, h.page, arg_min(d.doc_id, (-length(d.title), d.title)) AS doc_id FROM hints h LEFT JOIN docs d ON contains(h.text, d.title) GROUP BY 1, 2) h LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM chunks GROUP BY 1, 2) p ON p.doc_id = h.doc_id AND p.page = h.page", _HINTS))
def j15_titles(v: Views) -> DataFrame:
    """The document whose title a hint names, by the longest title in it, and whether the page it names exists."""
    i = F.col("doc_id")
    named = F.when(i % 4 == 3, "nothing").otherwise(F.col("title"))
    hints = v.docs().select(i.alias("hint_id"), F.concat(F.lit("see "), named, F.lit(" and p."), (i % 7 + 1).cast("string")).alias("text"))
    titles = v.docs().select("doc_id", F.col("title").alias("key"))
    found = patterns.longest(hints, titles, "hint_id", F.col("text")).join(titles, "key").select("hint_id", "doc_id")
    known = v.chunks().select("doc_id", "page").distinct().withColumn("known", F.lit(True))
    rows = hints.select("hint_id", F.regexp_extract("text", r"p\.(\d+)", 1).cast("int").alias("page")).join(found, "hint_id", "left").join(known, ["doc_id", "page"], "left")
    return rows.select("hint_id", "doc_id", F.when(F.col("doc_id").isNull(), "no_title").when(F.col("known").isNull(), "page_absent").otherwise("ok").alias("reason"))


@query("Q14_parsed_entities", sql("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a,' || lang WHEN 1 THEN lang ELSE '' END AS entities FROM documents"))
def q14(v: Views) -> DataFrame:
    """Answers fenced and bare, and such as hold no list."""
    i, lang = F.col("doc_id") % 4, F.col("lang")
    answer = F.when(i == 0, F.concat(F.lit('```json\n{"entities": ["a", " '), lang, F.lit('", "", "a"]}\n```'))).when(i == 1, F.concat(F.lit('{"entities": ["'), lang, F.lit('"]}'))).when(i == 2, '{"entities": "x"}').otherwise("none found")
    return v.table("documents").select("doc_id", F.array_join(Q.named_entities(answer), ",").alias("entities"))


@query("T8_composed_captions", sql("SELECT chunk_id, sha256(whole) AS suffixed, sha256(CASE WHEN chunk_idx % 4 = 0 THEN '[p.' || page || '] ' || left('[표] Table ' || (page + 2) || ' caption of ' || left(text, 20), 200) || chr(10) || chr(10) || text ELSE text END) AS prefixed FROM capt", _CAPTIONED))
def t8(v: Views) -> DataFrame:
    """Captions after the text, and by option in front of it with the page, cut to 200 characters."""
    caption = F.when(F.col("chunk_idx") % 4 == 0, F.concat(F.lit("[표] Table "), (F.col("page") + 2).cast("string"), F.lit(" caption of "), F.left("text", F.lit(20))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return v.chunks().select("chunk_id", sha(T.composed(F.col("text"), caption)).alias("suffixed"), sha(T.composed(F.col("text"), caption, F.col("page"))).alias("prefixed"))


@query("M10_grounding", sql("SELECT query_id, round(max(CASE WHEN cap <> '' THEN list_cosine_similarity(q.vec, x.vec) END), 6) AS grounding FROM queries q, (SELECT c.doc_id, regexp_extract(whole, '\\[표\\] (.+)', 1) AS cap, v.vec FROM capt c JOIN vecs v USING (doc_id) WHERE chunk_idx = 4) x WHERE query_id % 20 = 0 GROUP BY query_id".replace("\\\\", "\\"), _CAPTIONED))
def m10(v: Views) -> DataFrame:
    """Of every query whose id is divisible by 20 the greatest cosine with a caption's vector; null without captions."""
    lines = _captioned(v).filter("chunk_idx = 4").select("doc_id", F.regexp_extract("whole", r"\[표\] (.+)", 1).alias("caption")).filter("caption <> ''")
    asked = v.queries().filter("query_id % 20 = 0")
    best = retrieval.dense(lines.join(v.vecs(), "doc_id"), asked, 1, "doc_id")
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.round("sim", 6).alias("grounding"))


@query("N13_partial_rescore", sql("SELECT query_id, chunk_id, CASE WHEN whole <> hits.text THEN round(list_cosine_similarity(q.vec, v.vec), 6) ELSE round(rrf, 6) END AS score, length(regexp_replace(whole, '(?s)\\s*\\[표\\] .+$', '')) AS chars FROM hits JOIN (SELECT chunk_id, whole FROM capt) USING (chunk_id) JOIN vecs v USING (doc_id) JOIN queries q USING (query_id)".replace("\\\\", "\\"), _HITS, _CAPTIONED))
def n13(v: Views) -> DataFrame:
    """Hits without their captions: those that had one are scored anew by cosine, the others keep their score."""
    hits = hybrid(v).join(_captioned(v), "chunk_id").join(v.vecs(), "doc_id").join(v.queries().select("query_id", F.col("vec").alias("asked")), "query_id")
    bare = F.regexp_replace("whole", r"(?s)\s*\[표\] .+$", "")
    anew = F.when(bare != F.col("whole"), retrieval.cosine("vec", "asked"))
    return hits.select("query_id", "chunk_id", F.round(F.coalesce(anew, "rrf"), 6).alias("score"), F.char_length(bare).alias("chars"))


