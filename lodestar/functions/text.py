"""Text functions as columns: normalising, chunk quality, entities, private data, queries."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

# Watermark words; thresholds of the chunk filter.
WATERMARKS = ["대외비", "내부자료", "보안", "CONFIDENTIAL", "INTERNAL"]
SHORT_LINE, SHORT_LINES, DIGITS = 30, 0.90, 0.70
EXTREME_SHORT, NOISE_FROM, REPEATS, REPEAT_CHARS = 20, 50, 3, 100


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode composed form."""
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfd(text: pa.Array) -> pa.Array:
    """Unicode decomposed form."""
    return pa.array([None if x is None else unicodedata.normalize("NFD", x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def name_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sequence-matcher ratio of two names in small letters."""
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def no_nul(text: Column) -> Column:
    """Without NUL characters."""
    return F.translate(text, "\x00", "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_table_cell(text: Column) -> Column:
    """Holds a cell bar, or is under 30 characters with half of them digits or signs."""
    signs = _count(text, r"[^\p{L}\s]")
    return F.contains(text, F.lit(" | ")) | ((F.char_length(text) < 30) & (F.char_length(text) > 0) & (2 * signs >= F.char_length(text)))


def short_line_ratio(text: Column) -> Column:
    """Share of lines under 30 characters when trimmed."""
    lines = F.split(text, "\n", -1)
    return F.size(F.filter(lines, lambda x: F.char_length(F.regexp_replace(x, r"^\s+|\s+$", "")) < SHORT_LINE)) / F.size(lines)


def digit_ratio(text: Column) -> Column:
    """Characters that are no letters, blanks among them, by characters that are no blanks; it can exceed 1."""
    return F.coalesce(_count(text, r"[^\p{L}]") / F.nullif(_count(text, r"\S"), F.lit(0)), F.lit(0.0))


def filtered_reason(text: Column, repeats: Column) -> Column:
    """Why a chunk is left out of the search, null where it stays; `repeats` is how often its
    trimmed text occurs in its document."""
    bare = F.trim(text, F.lit(" \t\r\n"))
    n = F.char_length(bare)
    return (
        F.when(n == 0, "empty")
        .when((n < EXTREME_SHORT) & ~bare.rlike(r"\p{L}"), "extreme_short")
        .when((n < REPEAT_CHARS) & (repeats >= REPEATS), "header_footer")
        .when(F.char_length(text) < NOISE_FROM, F.lit(None))
        .when((short_line_ratio(text) >= SHORT_LINES) & (digit_ratio(text) >= DIGITS), "table_noise")
    )


def watermarks(text: Column) -> Column:
    """Watermark words as they are spelled, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + "|".join(WATERMARKS)), F.lit(0))))


# Registration numbers (year, month, day and seven digits) and cards of four groups.
RRN = r"\b(\d{6})[-\s]?(\d{7})\b"
CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,7}\b"
_RRN, _CARD = re.compile(RRN), re.compile(CARD)


@F.arrow_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def pii_ranges(text: pa.Array) -> pa.Array:
    """Sorted ranges of registration numbers with a real month and day, and of cards."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def of(t: str) -> list[dict]:
        found = {m.span() for m in _RRN.finditer(t) if 1 <= int(m[1][2:4]) <= 12 and 1 <= int(m[1][4:]) <= 31}
        found |= {m.span() for m in _CARD.finditer(t)}
        return [{"start": s, "end": e} for s, e in sorted(found)]

    return pa.array([None if t is None else of(t) for t in text.to_pylist()], kind)


def cards(text: Column) -> Column:
    """The card numbers of a text."""
    return F.regexp_extract_all(text, F.lit(CARD), F.lit(0))


# Entity patterns, in order of kind.
DATES = [r"(\d{4})\s*년\s*(\d{1,2})\s*월(?:\s*(\d{1,2})\s*일)?", r"(?<!\d)(\d{4})[.\-/]\s*(\d{1,2})[.\-/]\s*(\d{1,2})(?!\d)", r"(?<!\d)(\d{4})[.\-]\s*(\d{1,2})(?!\d)"]
AMOUNTS = [r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*원\b", r"\b\d{1,4}(?:\.\d+)?\s*(?:만|억|조|천)\s*원\b", r"\$\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", r"₩\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"]
PERCENTS = [r"\b\d{1,3}(?:\.\d+)?\s*%"]
IDENTIFIERS = [r"\bISSN\s+(\d{4}-\d{3}[\dXx])\b", r"\bISBN\s+([\d\-Xx]{10,17})\b", r"제\s*\d+\s*호"]


def _entities(text: Column, patterns: list[str]) -> Column:
    # (?U): letters of every script are word characters, so that a particle after a sum is no word boundary
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)) for p in patterns]))


def entities(text: Column) -> Column:
    """Dates, amounts, percents and identifiers, each in order of pattern and place, each once."""
    return F.struct(_entities(text, DATES).alias("dates"), _entities(text, AMOUNTS).alias("amounts"), _entities(text, PERCENTS).alias("percents"), _entities(text, IDENTIFIERS).alias("identifiers"))


def merged_tags(topics: Column, found: Column) -> Column:
    """Topic tags, then entity tags, each once."""
    return F.array_distinct(F.concat(topics, found))


def embedding_source(summary: Column, implications: Column, text: Column) -> Column:
    """The summary with its implications, else the first 3,000 characters."""
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat_ws("\n", summary, implications)).otherwise(F.left(text, F.lit(3000)))


def is_scan(text: Column) -> Column:
    """At most 50 characters of text."""
    return F.char_length(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))) <= 50


def composed(text: Column, caption: Column, page: Column | None = None) -> Column:
    """The text with its caption after it, or with a page in front of it, cut to 200 characters; a null caption adds nothing."""
    if page is None:
        return F.concat_ws("\n\n", text, caption)
    return F.concat_ws("\n\n", F.concat(F.lit("[p."), page.cast("string"), F.lit("] "), F.left(caption, F.lit(200))), text)


def synonym_words(text: Column, pairs: list[tuple[str, str]], most: int = 5) -> Column:
    """The words, in order of their keys, whose key the text has and that it lacks itself."""
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(w).alias("word")) for k, w in sorted(pairs)])
    return F.slice(F.transform(F.filter(table, lambda p: F.contains(text, p.key) & ~F.contains(text, p.word)), lambda p: p.word), 1, most)


def with_synonym_marker(text: Column, words: Column) -> Column:
    """The text with a search-word marker at its end where there are words."""
    return F.when(F.size(words) > 0, F.concat(text, F.lit("\n\n[검색어: "), F.array_join(words, ", "), F.lit("]"))).otherwise(text)


def article_blocks(html: Column) -> Column:
    """The texts of the blocks of a page's article element, without markup; empty without one."""
    body = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    parts = F.split(body, r"</?(?:p|h[1-6]|li|ul|ol|blockquote)\b[^>]*>")
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"<[^>]*>", " "))
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(bare, lambda x: F.trim(F.regexp_replace(plain(x), r"\s+", " "))), lambda x: x != "")


def main_paragraphs(html: Column) -> Column:
    """The paragraphs of a page's main text: of its article, else its main element, else its body without
    what frames it.  Blocks are parted by blank lines; where that gives one paragraph at most, lines count."""
    part = lambda name: F.regexp_extract(html, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    framed = F.regexp_replace(part("body"), r"(?is)<nav(?:\s[^>]*)?>.*?</nav\s*>|<header(?:\s[^>]*)?>.*?</header\s*>|<footer(?:\s[^>]*)?>.*?</footer\s*>|<aside(?:\s[^>]*)?>.*?</aside\s*>|<form(?:\s[^>]*)?>.*?</form\s*>", "\n\n")
    body = F.coalesce(F.when(part("article") != "", part("article")), F.when(part("main") != "", part("main")), framed)
    body = F.regexp_replace(body, r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->", "")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t\r\n]+", " "), r"(?i)<br\s*/?>", "\n")
    body = F.regexp_replace(body, r"(?i)</?(?:p|h[1-6]|li|ul|ol|blockquote|div|table|tr|section)(?:\s[^>]*)?>", "\n\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    plain = F.replace(F.replace(F.replace(body, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    cut = lambda by: F.filter(F.transform(F.split(plain, by, -1), lambda x: F.trim(x, F.lit(" \n"))), lambda x: x != "")
    return F.when(F.size(cut(r"\n *\n")) <= 1, cut(r"\n")).otherwise(cut(r"\n *\n"))


def without_synonym_marker(text: Column) -> Column:
    """Without the search-word marker at the end."""
    return F.regexp_replace(text, r"\n*\[검색어:[^\]]*\]\s*$", "")


# How headings read, and page headers and numbers that are none.
HEADING_RATIO, HEADING_CHARS = 1.15, 80
HEADING = (
    r"^("
    r"제\s*\d+\s*[조항장절편관]|부칙|별표\s*\d*|별첨\s*\d*"
    r"|【[^】]{1,30}】|\[[^\]]{1,30}\]"
    r"|Chapter\s*\d*|Section\s*\d*"
    r"|\d+(?:\.\d+){0,3}\.?\s+[A-Z][A-Za-z]*"
    r"|(?:Abstract|Introduction|Background|Related\s+Work|Methodology|Methods?"
    r"|Experiments?|Evaluation|Results?|Findings?|Discussion|Conclusions?"
    r"|References|Bibliography|Acknowledg(?:e?)ments?|Appendix(?:\s+[A-Z])?)"
    r")([\s(].*)?$"
)
PAGE_HEADER = r"(?i)^(arXiv:\s*\d+\.\d+(v\d+)?(\s*\[[A-Za-z\-\.]+\])?(\s+.+)?|\d{1,4}|Page\s*\d+|-\s*\d+\s*-)\s*$"


def heading(text: Column, size: Column, median: Column) -> Column:
    """No page header or number, and set 1.15 times the page's median or larger, or a short line that reads like a heading."""
    short = F.char_length(text) <= HEADING_CHARS
    return ~(short & text.rlike(PAGE_HEADER)) & (((median > 0) & (size >= HEADING_RATIO * median)) | (short & text.rlike(HEADING)))


_OPEN = [("“", "”"), ("‘", "’"), ("(", ")"), ("[", "]"), ("{", "}"), ("「", "」"), ("『", "』")]


def is_unbalanced(text: str) -> bool:
    """An odd number of double quotes, or more opening than closing marks of a pair."""
    return text.count('"') % 2 == 1 or any(text.count(a) > text.count(b) for a, b in _OPEN)


_ENDS = re.compile(r"(?<=[가-힣)\]][.!?])\s+|\n\s*\n")
_LEGAL = re.compile(r"\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.")


def pack(text: str, target: int = 800, most: int = 1000, overlap: int = 100) -> list[str]:
    """Sentences packed into pieces near `target`, at most `most`, each led by the end of the one before.

    An open quote or bracket draws the next sentence in while it fits.  Legal dates are
    no sentence ends.
    """
    dates = [m.span() for m in _LEGAL.finditer(text)]
    inside = lambda i: any(s <= i < e for s, e in dates)
    sentences, start = [], 0
    for m in _ENDS.finditer(text):
        if not inside(m.start()):
            sentences.append(text[start : m.start()])
            start = m.end()
    sentences.append(text[start:])
    pieces: list[str] = []
    now = ""
    for s in filter(None, sentences):
        grown = f"{now} {s}".strip() if now else s
        size = len(now) + len(s) + 1
        if not now or size <= target or (size <= most and is_unbalanced(now)):
            now = grown
        else:
            pieces.append(now.strip())
            now = s
    if now:
        pieces.append(now.strip())
    cut = [x for p in pieces for x in ([p] if len(p) <= most else [p[i : i + target] for i in range(0, len(p), target)])]
    out = []
    for i, p in enumerate(cut):
        room = min(overlap, most - len(p) - 1)
        out.append(f"{cut[i - 1][-room:]} {p}".strip() if i and room > 0 else p)
    return out


@F.arrow_udf(ArrayType(StringType()))
def packed(text: pa.Array) -> pa.Array:
    """`pack` over a column: texts up to 1,000 characters stay whole."""
    return pa.array([None if t is None else ([t] if len(t) <= 1000 else pack(t)) for t in text.to_pylist()], pa.list_(pa.string()))
