"""What a query asks for: signals, labels, dates, tags.  Built-in functions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the seven signals.
NOUNS = "자료|문서|보고서|안내서|규정|내규|이력서|포트폴리오|포폴|템플릿|판결|계획|사업|매뉴얼|카탈로그|논문"
CROSS = [
    r"(자료|문서|보고서).{0,15}(랑|와|과|및).{0,15}(자료|문서)",
    rf"[가-힣A-Za-z0-9]+\s*(?:와|과|랑)\s*[가-힣A-Za-z0-9].{{0,15}}(?:{NOUNS})",
    rf"(?:{NOUNS})\S*\s*(?:와|과|랑)\s*[가-힣A-Za-z0-9]",
    rf"(?:{NOUNS})들\s*(?:에서|에|중에서|중에|중)",
]
COMPARE = ["차이", "비교", "vs", "달라", "대비"]
COMPARE_STEM = "다르[게지]|다른[가지]|다릅|상이"
CAUSE = ["왜", "이유", "때문", "원인", "어째서"]
CHANGE = ["달라진", "바뀐", "변경", "수정된", "업데이트"]
VAGUE = ["그거", "그때", "그 ", "어디였더라", "뭐였지", "어떻게 됐더라"]
# Words of the query labels, in order of priority, and of the comment labels.
LABELS = [
    ("vision_diagram", ["다이어그램", "그림", "도식", "구조도", "이미지", "사진", "도표"]),
    ("table_lookup", ["표", "리스트", "목록", "별표", "카테고리", "항목 목록"]),
    ("cross_doc", ["비교", "차이", "대비", "달라", "차이점"]),
    ("numeric_lookup", ["얼마", "금액", "가격", "비용", "수치", "수량", "개수", "지원금"]),
    ("summary", ["요약", "핵심", "정리", "개요", "짧게", "한줄", "한 줄"]),
    ("fuzzy_memory", ["그때", "어디 있더라", "어디 있었", "뭐였지", "있었나", "있었지", "었더라", "았더라", "기억나"]),
]
NUMERIC = [r"\d+(?:\.\d+)?\s*(?:개월|시간|kg|km|cm|%|원|년|월|일|회|건|개|점|명|분|초|m)", r"몇\s*[가-힣]", r"얼마"]
SYNONYMS = [("개인정보", "비식별화"), ("환자 정보", "비식별화"), ("색상", "컬러"), ("시트", "가죽"), ("규정", "내규"), ("직원", "임직원"), ("회의", "협의")]
COMMENTS = [
    ("source_issue", ["출처", "근거 없", "어디서", "인용", "페이지", "이상한 자료"]),
    ("search_issue", ["검색", "찾을 수 없", "관련 없", "나오지 않", "chunk", "검색 결과"]),
    ("answer_issue", ["답변", "정확하지 않", "잘못", "틀린", "오답", "환각"]),
]
# Relative days as (word, first day from today, number of days), the first that occurs counts.
RELATIVE = [("오늘", 0, 1), ("어제", -1, 1), ("그저께", -2, 1), ("이번주", -6, 7), ("지난주", -13, 7), ("이번달", -29, 30), ("지난달", -59, 30)]


# Endings of document names, question words, request words and one-letter particles of a plain filter query.
SUFFIXES = ["문서", "보고서", "자료", "회의록", "기획서", "파일", "리포트", "요약", "공문", "계약서"]
QUESTIONS = ["어떻게", "왜", "언제", "어디", "누가", "뭐야", "뭐", "무엇", "얼마", "몇", "어떤", "어느", "할까", "있나", "없나", "되나", "인가"]
REQUESTS = ["보여줘", "보여", "찾아줘", "찾아", "열어줘", "열어", "줘", "주세요", "알려줘", "알려"]
PARTICLES = ["을", "를", "의", "에", "는", "가", "이", "도", "만", "와", "과", "랑"]
#: Words that a document name in a query may have, and characters of a query and of an id.
NAME_WORDS, QUERY_CHARS, ID_CHARS = 5, 200, 64


def has_any(text: Column, words: list[str]) -> Column:
    """Holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def normal(query: Column) -> Column:
    """Trimmed, with single blanks; compose the text first where it may be decomposed."""
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def _occurs(text: Column, word: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))


def signals(query: Column) -> Column:
    """The signals that fire, in order."""
    q = normal(query)
    t1 = reduce(lambda a, b: a | b, [q.rlike(p) for p in CROSS])
    fired = [
        ("T1_cross_doc", t1),
        ("T2_compare", has_any(q, COMPARE) | q.rlike(COMPARE_STEM)),
        ("T3_causal", has_any(q, CAUSE)),
        ("T4_change", has_any(q, CHANGE)),
        ("T5_long_query", (F.char_length(q) >= 40) | (F.size(F.split(q, " ")) >= 12)),
        ("T6_low_confidence", has_any(q, VAGUE)),
        ("T7_multi_target", ~t1 & (_occurs(q, "랑") + _occurs(q, "과") >= 2)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired]))


def needs_decomposition(fired: Column) -> Column:
    """(T1 or T2 or T3 or T7) or (T5 and T6)."""
    has = lambda s: F.array_contains(fired, s)
    return has("T1_cross_doc") | has("T2_compare") | has("T3_causal") | has("T7_multi_target") | (has("T5_long_query") & has("T6_low_confidence"))


def confidence(fired: Column) -> Column:
    """1 less 0.15 for each signal, less 0.3 for a vague one, within 0 and 1."""
    score = 1.0 - 0.15 * F.size(fired) - F.when(F.array_contains(fired, "T6_low_confidence"), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def label(query: Column, source: Column | None = None, negative: Column | None = None) -> Column:
    """One of nine labels, by fixed priority."""
    q = F.trim(query)
    out = F.when(negative if negative is not None else F.lit(False), "out_of_scope")
    for name, words in LABELS:
        hit = has_any(q, words)
        if name == "numeric_lookup":
            hit = reduce(lambda a, b: a | b, [q.rlike(p) for p in NUMERIC]) | hit
        if name == "fuzzy_memory" and source is not None:
            crossed = [(F.contains(q, F.lit(a)) & F.contains(source, F.lit(b)) & ~F.contains(source, F.lit(a))) | (F.contains(q, F.lit(b)) & F.contains(source, F.lit(a)) & ~F.contains(source, F.lit(b))) for a, b in SYNONYMS]
            out = out.when(reduce(lambda a, b: a | b, crossed), "synonym_mismatch")
        out = out.when(hit, name)
    return out.otherwise("exact_fact")


def comment_label(comment: Column) -> Column:
    """One of four labels; blank and unknown comments are `other`."""
    c = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    out = F.when(c == "", "other")
    for name, words in COMMENTS:
        out = out.when(has_any(c, words), name)
    return out.otherwise("other")


def tags(query: Column) -> Column:
    """Hashtags in order, each once."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"#([A-Za-z0-9가-힣_\-]+)"), F.lit(1)))


def date_range(query: Column, today: str) -> Column:
    """struct(start, end) of the first date expression, end exclusive; null without one and for an impossible date."""

    def day(pattern: str) -> Column:
        part = [F.regexp_extract(query, pattern, i) for i in (1, 2, 3)]
        return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")

    iso, ko = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    month = r"(\d{4})\s*년\s*(\d{1,2})\s*월"
    first = F.try_to_date(F.concat_ws("-", F.regexp_extract(query, month, 1), F.lpad(F.regexp_extract(query, month, 2), 2, "0"), F.lit("01")), "yyyy-MM-dd")
    pair = lambda s, e: F.when(s.isNotNull(), F.struct(s.alias("start"), e.alias("end")))
    out = F.when(query.rlike(iso), pair(day(iso), F.date_add(day(iso), 1))).when(query.rlike(ko), pair(day(ko), F.date_add(day(ko), 1)))
    out = out.when(query.rlike(month), pair(first, F.add_months(first, 1)))
    now = F.lit(today).cast("date")
    for word, start, size in RELATIVE:
        out = out.when(F.contains(query, F.lit(word)), F.struct(F.date_add(now, start).alias("start"), F.date_add(now, start + size).alias("end")))
    return out


TAG = r"#([A-Za-z0-9가-힣_\-]+)"
DATES = [r"\d{4}[-./]\d{1,2}[-./]\d{1,2}", r"\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일", r"\d{4}\s*년\s*\d{1,2}\s*월"]


def residual(query: Column) -> Column:
    """The words of a query besides its tags and dates."""
    left = reduce(lambda q, p: F.regexp_replace(q, p, " "), [TAG, *DATES, *(r[0] for r in RELATIVE)], normal(query))
    return F.filter(F.split(left, r"\s+"), lambda w: w != "")


def name_words(words: Column) -> Column:
    """Words without a particle at their end and without requests."""
    bare = F.transform(words, lambda w: F.when((F.char_length(w) >= 2) & F.right(w, F.lit(1)).isin(PARTICLES), F.left(w, F.char_length(w) - 1)).otherwise(w))
    return F.filter(bare, lambda w: ~w.isin(REQUESTS))


def filter_plan(query: Column, today: str) -> Column:
    """struct(kind, start, end, tags, title) where a query only names dates, tags or a document,
    null where it asks for more.

    A question word anywhere else, or words that are no document name, ask for more.  A
    name has NAME_WORDS words at most, and one with a document ending unless a date or tag is
    there too.
    """
    found, when, words = tags(query), date_range(query, today), residual(query)
    named = name_words(words)
    guarded = when.isNotNull() | (F.size(found) > 0)
    ending = F.exists(named, lambda w: has_any(w, SUFFIXES))
    is_name = (F.size(words) <= NAME_WORDS) & (F.size(named) > 0) & (ending | guarded)
    asks = F.exists(words, lambda w: has_any(w, QUESTIONS)) | ((F.size(named) > 0) & ~is_name)
    kind = F.concat_ws("+", F.when(when.isNotNull(), "date"), F.when(F.size(found) > 0, "tag"), F.when(is_name, "title"))
    plan = F.struct(kind.alias("kind"), when["start"].alias("start"), when["end"].alias("end"), found.alias("tags"), F.when(is_name, F.array_join(named, " ")).alias("title"))
    return F.when(~asks & (kind != ""), plan)


def problem(query: Column, doc_type: Column, mode: Column, doc_id: Column, types: list[str], modes: list[str]) -> Column:
    """Why a search is turned down, null where it is fine; nulls of the filters are no filter."""
    bare = F.trim(query)
    own = F.trim(doc_id)
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "empty_query")
        .when(F.char_length(query) > QUERY_CHARS, "long_query")
        .when(doc_type.isNotNull() & ~doc_type.isin(types), "doc_type")
        .when(own.isNotNull() & ((own == "") | (F.char_length(own) > ID_CHARS)), "doc_id")
        .when(mode.isNull() | ~mode.isin(modes), "mode")
    )


def term_pairs(answer: Column, most: int = 8) -> Column:
    """array<struct<term, synonyms>>: the pairs of a JSON answer, fenced or not; pairs without a term or a
    synonym are left out, and only the first `most` count."""
    body = F.regexp_replace(F.regexp_replace(answer, r"^\s*```(json)?", ""), r"```\s*$", "")
    pairs = F.from_json(body, "pairs array<struct<term: string, synonyms: array<string>>>")["pairs"]
    clean = F.transform(pairs, lambda p: F.struct(F.trim(p.term).alias("term"), F.filter(F.transform(p.synonyms, lambda x: F.trim(x)), lambda x: x != "").alias("synonyms")))
    good = F.filter(clean, lambda p: F.coalesce(p.term != "", F.lit(False)) & (F.size(p.synonyms) > 0))
    return F.slice(F.coalesce(good, F.array().cast("array<struct<term: string, synonyms: array<string>>>")), 1, most)


def sub_queries(answer: Column) -> Column:
    """Two to five strings of the first JSON list in an answer, else an empty list."""
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\[.*?\]", 0), "array<string>")
    kept = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept).between(2, 5), kept).otherwise(F.array().cast("array<string>"))


def named_entities(answer: Column) -> Column:
    """The strings of a JSON answer's `entities`, fenced or not, trimmed, each once; empty where there is no such list."""
    body = F.regexp_replace(F.regexp_replace(answer, r"^\s*```(json)?", ""), r"```\s*$", "")
    found = F.from_json(body, "entities array<string>")["entities"]
    kept = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.coalesce(kept, F.array().cast("array<string>")))


def hashed(query: Column, enabled: bool = True) -> Column:
    """The query, or its sha256 where queries are private."""
    return F.sha2(query.cast("binary"), 256) if enabled else query
