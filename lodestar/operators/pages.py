"""Page signals, incremental page work and repairs of chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The triggers and weights of the page score; bad text is 1 less the text quality.
TRIGGERS = {"density": 0.5, "table_like": 0.5, "image_area": 0.3, "text_quality": 0.6, "caption": 0.2}
WEIGHTS = {"density": 0.3, "table_like": 0.25, "image_area": 0.2, "text_quality": 0.1, "caption": 0.15}


def clamped(x: Column) -> Column:
    """Within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def need_score(low_density: Column, table_like: Column, image_area: Column, bad_text: Column, caption: Column) -> list[Column]:
    """The weighted score of a page, and whether any signal alone asks for a closer look."""
    signals = dict(zip(TRIGGERS, map(clamped, (low_density, table_like, image_area, bad_text, caption))))
    total = sum((signals[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    fired = F.lit(False)
    for k, t in TRIGGERS.items():
        fired |= signals[k] >= t
    return [total.alias("score"), fired.alias("needed")]


def text_quality(text: Column) -> Column:
    """Printable letters, digits and common signs by characters that are no blanks; 0 without any."""
    good = F.regexp_count(text, F.lit(r"[\p{L}\p{N}.,;:!?'\"()\[\]%&+\-/]"))
    return F.coalesce(good / F.nullif(F.regexp_count(text, F.lit(r"\S")), F.lit(0)), F.lit(0.0))


def is_multi_column(line: Column) -> Column:
    """A line that parts into three cells or more by wide gaps."""
    return F.size(F.split(F.trim(line), r"\s{2,}|\t")) >= 3


def is_caption(line: Column) -> Column:
    """A short line that names a figure or table."""
    return (F.char_length(line) <= 80) & line.rlike(r"(?i)^\s*(그림|표|figure|fig\.|table)\s*\d+")


def missing_pages(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, page, new_idx): pages not processed yet, numbered on from the document's last chunk."""
    last = done.groupBy("doc_id").agg(F.max("chunk_idx").alias("_last"))
    todo = wanted.join(done.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").join(last, "doc_id", "left")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return todo.withColumn("new_idx", F.coalesce("_last", F.lit(-1)) + k).drop("_last")


def neighbours(hits: DataFrame, chunks: DataFrame, eligible: Column) -> DataFrame:
    """(query_id, chunk_id): eligible chunks next to an eligible hit that are no hits themselves."""
    ok = chunks.filter(eligible).select("chunk_id", "doc_id", "chunk_idx")
    near = hits.select("query_id", "chunk_id").join(ok, "chunk_id").select("query_id", "doc_id", F.explode(F.array(F.col("chunk_idx") - 1, F.col("chunk_idx") + 1)).alias("chunk_idx")).distinct()
    found = near.join(ok, ["doc_id", "chunk_idx"]).select("query_id", "chunk_id")
    return found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, terms): the query's words with their synonyms, both ways, each once."""
    both = synonyms.select(F.lower("a").alias("w"), F.col("b").alias("s")).unionByName(synonyms.select(F.lower("b").alias("w"), F.col("a").alias("s")))
    words = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("at", "word"))
    more = words.join(both, F.lower("word") == F.col("w")).select("query_id", "at", F.lit(1).alias("kind"), F.col("s").alias("word"))
    every = words.select("query_id", "at", F.lit(0).alias("kind"), "word").unionByName(more)
    first = every.groupBy("query_id", F.lower("word").alias("k")).agg(F.min(F.struct("at", "kind", "word")).alias("x"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.word).alias("terms"))


def changed(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose value differs, nulls told apart: what a backfill has to write."""
    n = new.select(key, F.col(column).alias("_new"))
    return old.join(n, key).filter(~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def parsed_judgement(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, idx, score): scores of a JSON list of {idx, score}, within 0 and 1; the last
    of an index counts, an index that is missing has 0."""
    body = F.regexp_replace(F.regexp_replace("answer", r"^\s*```(json)?", ""), r"```\s*$", "")
    rows = answers.select("query_id", F.posexplode(F.from_json(body, "array<struct<idx:int,score:double>>")).alias("at", "x"))
    last = rows.groupBy("query_id", F.col("x.idx").alias("idx")).agg(F.max_by("x.score", "at").alias("score"))
    return expected.join(last, ["query_id", "idx"], "left").withColumn("score", clamped(F.coalesce("score", F.lit(0.0))))


def judged(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, idx, score, reason) of every expected index, over answers (query_id, answer).

    A JSON list of {chunk_idx, score}, fenced or not; the last of an index counts, entries
    without a whole number are left out, scores that are no numbers count 0, others are kept
    within 0 and 1.  An answer that is no list is `unparsable`, an index without one `missing`; both score 0.
    """
    body = F.regexp_replace(F.trim("answer"), r"^```(?:json)?\s*|\s*```$", "")
    items = F.from_json(body, "array<struct<chunk_idx:string,score:string>>")
    whole = body.rlike(r"(?s)^\s*\[.*\]\s*$") & items.isNotNull()
    told = answers.select("query_id", F.when(whole, items).alias("items"))
    rows = told.select("query_id", F.posexplode("items").alias("at", "x")).select("query_id", "at", F.col("x.chunk_idx").try_cast("int").alias("idx"), clamped(F.coalesce(F.col("x.score").try_cast("double"), F.lit(0.0))).alias("score"))
    last = rows.filter("idx IS NOT NULL").groupBy("query_id", "idx").agg(F.max_by("score", "at").alias("score"))
    state = told.groupBy("query_id").agg(F.bool_or(F.col("items").isNotNull()).alias("_parsed"))
    both = expected.join(last, ["query_id", "idx"], "left").join(state, "query_id", "left")
    reason = F.when(F.col("score").isNotNull(), F.lit(None)).when(F.col("_parsed") == F.lit(False), "unparsable").otherwise("missing")
    return both.select("query_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason"))


def skip_reason(acceptable: Column, negative: Column, doc: Column, relevant: Column) -> Column:
    """Why a golden row is not judged, the first that holds; null for one that is."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")))
    whole = F.filter(F.split(F.coalesce(relevant, F.lit("")), ","), lambda x: F.trim(x).rlike(r"^[+-]?[0-9]+$"))
    return F.when(bare(acceptable) != "", "already_filled").when(F.lower(bare(negative)) == "true", "negative").when(bare(doc) == "", "no_doc_id").when(F.size(whole) == 0, "no_relevant")


def reset(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents, those of `ids` as before their ingest: no tags, summary or vector, and of their flags the mode alone."""
    hit = F.col("_hit").isNotNull()
    rows = docs.join(ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    values = {"tags": F.array().cast("array<string>"), "summary": F.lit(None), "vec": F.lit(None), "flags": F.map_filter(F.coalesce("flags", F.create_map().cast("map<string,string>")), lambda k, _: k == "ingest_mode")}
    return rows.withColumns({c: F.when(hit, v.cast(docs.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}).select(docs.columns)


def failed(docs: DataFrame, errors: DataFrame, at: str, chars: int = 500) -> DataFrame:
    """Documents, those of `errors` (doc_id, error) without a vector and with failed, failed_at and error_msg added to their flags."""
    rows = docs.join(errors.select("doc_id", F.left("error", F.lit(chars)).alias("_error")), "doc_id", "left")
    new = F.create_map(F.lit("failed"), F.lit("true"), F.lit("failed_at"), F.lit(at), F.lit("error_msg"), F.col("_error"))
    old = F.map_filter(F.coalesce("flags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("failed", "failed_at", "error_msg"))
    hit = F.col("_error").isNotNull()
    return rows.withColumn("flags", F.when(hit, F.map_concat(old, new)).otherwise(F.col("flags"))).withColumn("vec", F.when(~hit, F.col("vec"))).select(docs.columns)


def quotas(counts: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, quota) over (stratum, n): each stratum's share of `size`, rounded half to even, at least one.

    Where the shares do not add up to `size`, the largest strata give or take one, as far as
    they can.  A row for each stratum, so the window over them is small.
    """
    every = Window.partitionBy(F.lit(0))
    q = counts.withColumn("q", F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("n") / F.sum("n").over(every)).cast("int")))
    q = q.withColumn("over", F.sum("q").over(every) - size).withColumn("can", F.when(F.col("over") > 0, F.col("q") > 1).otherwise(F.col("q") < F.col("n")))
    place = F.sum(F.col("can").cast("int")).over(every.orderBy(F.desc("n"), stratum).rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(F.col("can") & (place <= F.abs("over")), F.signum("over")).otherwise(0).cast("int")
    return q.select(stratum, (F.col("q") - step).alias("quota"))


#: Ranges of a draw that are counted for each stratum.
BINS = 65_536
#: Most strata whose cuts are broadcast: a few MB.  Each of more is joined in SALTS parts.
MAX_STRATA = 100_000
SALTS = 16


def stratified(rows: DataFrame, stratum: str, draw: Column, span: int, tie: str, size: int) -> DataFrame:
    """`size` rows by the quotas of their strata, those of the smallest `draw`, ties by `tie`; all rows where there are no more.

    `draw` is a whole number from 0 to `span` - 1, as a hash gives it.  Draws are counted in BINS
    ranges for each stratum, combined before the shuffle; the counts tell the range in which
    a quota ends, and only rows up to that range are put in order: the sample and a
    BINS-th of the stratum, about, and never the stratum.
    """
    bin_ = F.floor(draw.cast("double") * BINS / span).cast("int").alias("_bin")
    drawn = rows.select("*", draw.alias("_draw"), bin_)
    bins = drawn.groupBy(stratum, "_bin").agg(F.count("*").alias("_in"))
    counts = bins.groupBy(stratum).agg(F.sum("_in").alias("n"))
    upto = F.sum("_in").over(Window.partitionBy(stratum).orderBy("_bin"))
    cuts = bins.withColumn("_upto", upto).join(quotas(counts, stratum, size), stratum).groupBy(stratum).agg(F.min(F.when(F.col("_upto") >= F.col("quota"), F.col("_bin"))).alias("_cut"), F.first("quota").alias("quota"))
    few = counts.limit(MAX_STRATA + 1).agg(F.count("*").alias("strata"), F.sum("n").alias("n")).first()
    if (few["n"] or 0) <= size and few["strata"] <= MAX_STRATA:
        return rows
    if few["strata"] <= MAX_STRATA:
        near = drawn.join(F.broadcast(cuts), stratum)
    else:
        near = drawn.withColumn("_salt", F.pmod(F.xxhash64("_draw", tie), F.lit(SALTS)).cast("int")).join(cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [stratum, "_salt"])
    near = near.filter((F.col("_bin") <= F.col("_cut")) | F.col("_cut").isNull())
    k = F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", tie))
    return near.withColumn("_k", k).filter("_k <= quota").select(rows.columns)


def signals(lines: DataFrame) -> DataFrame:
    """(chunk_id, table_like, caption): shares of a chunk's lines that look like rows of a table, and like captions."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    told = lines.select("chunk_id", is_multi_column(F.col("line")).alias("t"), is_caption(F.col("line")).alias("c"))
    return told.groupBy("chunk_id").agg(share("t").alias("table_like"), share("c").alias("caption"))


def last_evaluation(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Asked rows (query, doc_id) with the latest cached row of the same query and document; a null document is one of its own."""
    rest = [c for c in cache.columns if c not in ("query", "doc_id")]
    last = cache.groupBy("query", "doc_id").agg(F.max_by(F.struct(*rest), "created_at").alias("_r")).withColumnsRenamed({"query": "_q", "doc_id": "_d"})
    found = asked.join(last, (F.col("query") == F.col("_q")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return found.select(*asked.columns, *[F.col("_r")[c].alias(c) for c in rest])


def gate(numbers: DataFrame, drift_pct: float, baseline: float, most_drop: float) -> DataFrame:
    """`numbers` (before, after, null_vectors, recall) with the first gate that fails, null where all pass."""
    drift = F.abs(F.col("after") - F.col("before")) / F.greatest(F.col("before"), F.lit(1)) * 100
    reason = F.when(drift > drift_pct, "chunks").when(F.col("null_vectors") > 0, "null_vectors").when(baseline - F.col("recall") > most_drop, "recall")
    return numbers.withColumn("failed", reason)


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's coefficient of every pair of columns, in one pass."""
    both = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in both]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def ablated(rows: DataFrame, triggers: dict[str, float], thresholds: list[float]) -> DataFrame:
    """(signal, threshold, needed): rows that the OR rule picks with one trigger moved, in one pass."""
    picked = []
    for moved in triggers:
        for t in thresholds:
            rule = F.lit(False)
            for signal, own in triggers.items():
                rule |= F.col(signal) >= (t if signal == moved else own)
            picked.append(F.struct(F.lit(moved).alias("signal"), F.lit(t).alias("threshold"), F.count_if(rule).alias("needed")))
    return rows.agg(F.array(*picked).alias("x")).select(F.explode("x").alias("x")).select("x.*")
