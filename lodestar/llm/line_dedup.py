"""Operator 3: line dedup by a deletion-neighbourhood join.  DataFrame functions only.

A line is trimmed of blanks; its words are what single blanks part.  Two lines are
duplicates when they are equal or, from `min_words` words on, when one word replaced,
inserted or removed turns one into the other (a word edit distance of one).  A line is
removed when an equal or near line stands earlier, by (id, line number).  Lines under
`min_chars` code points are left alone: they are too short to tell a copy.

How it runs.  One scan writes a narrow table of all lines: their place, 128 bits that
stand for them, and four hashed halves.  Two lines one edit apart share their first or
their last half; halves are counted, with combining before the shuffle, and lines that
share none with another line leave there.  The texts of the others are fetched from
their earliest places, and these lines emit all variants with up to one word deleted, in
the half that is not shared, as hashed keys.  For each key the earliest full line, the
earliest line with a deletion, and the earliest for each deleted place are aggregated, so
a group of any size gives one row and no pairs.  What those rows claim is then verified
on the words of both lines.

Null and empty texts have no lines, an empty table gives no rows.  Rows that share an id,
or have none, are told apart by a hash of their text and come in the order of that hash;
rows equal in both are one document, so all of them stay or go alike.  Blank lines are
never removed, very long lines are compared whole.  Columns other than the two named
travel along untouched in `clean`, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import finished, free, keyed, saved

MIN_CHARS = 16
MIN_WORDS = 10
#: Most lines whose places are broadcast to fetch their texts (about 40 MB); more are joined by a shuffle.
MAX_BROADCAST = 400_000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, line, body): every trimmed line long enough to count; line numbers start at 0.
    `doc` is the id beside a hash of the text."""
    rows = keyed(docs, id_col, text_col).select(F.col("_doc").alias("doc"), F.posexplode(F.split(F.col("_text"), "\n", -1)).alias("line", "raw"))
    body = F.trim(F.col("raw"), F.lit(" \t\r"))
    return rows.select("doc", "line", body.alias("body")).filter(F.char_length("body") >= min_chars)


def _size(body: str) -> Column:
    """The number of words."""
    return F.char_length(body) - F.char_length(F.replace(F.col(body), F.lit(" "), F.lit(""))) + 1


def _first(body: str, k: Column) -> Column:
    return F.call_function("substring_index", F.col(body), F.lit(" "), k)


def _halves(body: str, n: Column) -> Column:
    """(side, key) of the halves that two lines one edit apart must share, under the smaller size."""

    def both(size: Column) -> list[Column]:
        half = (size / 2).cast("int")
        return [
            F.struct(F.lit(0).alias("side"), F.xxhash64(size, F.lit("left"), _first(body, half)).alias("key")),
            F.struct(F.lit(1).alias("side"), F.xxhash64(size, F.lit("right"), _first(body, half - size)).alias("key")),
        ]

    return F.array(*both(n), *both(n - 1))


def hashed(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, line, h1, h2, halves) of every line; halves only from `min_words` words on."""
    sized = found.withColumn("n", _size("body"))
    halves = F.when(F.col("n") >= min_words, _halves("body", F.col("n")))
    return saved(sized.select("doc", "line", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(7), "body").alias("h2"), halves.alias("halves")), "lines")


def earliest(known: DataFrame) -> DataFrame:
    """(h1, h2, first): where each distinct line first stands."""
    return known.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"))


def near(found: DataFrame, known: DataFrame, first: DataFrame) -> DataFrame:
    """(h1, h2, near): distinct lines with the earliest place (doc, line) of an earlier near line."""
    halves = known.filter("halves IS NOT NULL").select("h1", "h2", F.explode("halves").alias("x")).select("h1", "h2", "x.side", "x.key")
    shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("key")
    maybe = halves.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    wanted = saved(maybe.join(first, ["h1", "h2"]).select("h1", "h2", "first.doc", "first.line", "lo", "hi"), "wanted")
    few = wanted.count() <= MAX_BROADCAST
    wanted = wanted.withColumnsRenamed({"doc": "d", "line": "l"})
    bodies = found.join(F.broadcast(wanted) if few else wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l"))).drop("d", "l")
    worded = saved(bodies.withColumn("n", _size("body")).dropDuplicates(["h1", "h2"]), "bodies")

    # Cuts in the half that is not shared; 0 is the full line.
    at, half = F.struct("doc", "line", "h1", "h2"), ((F.col("n") - 1) / 2).cast("int")
    begin, end = F.when(F.col("lo") == 0, F.when(F.col("hi") == 1, 1).otherwise(half + 1)).otherwise(1), F.when(F.col("hi") == 1, F.when(F.col("lo") == 0, F.col("n")).otherwise(half + 1)).otherwise(F.col("n"))
    cuts = worded.withColumn("cut", F.explode(F.concat(F.array(F.lit(0)), F.sequence(begin, end))))
    cut, n = F.col("cut"), F.col("n")
    before = F.when(cut == 1, "").otherwise(F.concat(_first("body", cut - 1), F.lit(" ")))
    after = F.when(cut == n, "").otherwise(F.concat(_first("body", cut - n), F.lit(" ")))
    key = F.xxhash64(F.when(cut == 0, F.concat("body", F.lit(" "))).otherwise(F.concat(before, after)))
    variants = cuts.select("h1", "h2", "doc", "line", "cut", key.alias("key"))

    # Lines with the same word cut out (replacement), and a full line against a cut one.
    by_cut = variants.groupBy("key", "cut").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    by_key = by_cut.groupBy("key").agg(
        F.min(F.when(F.col("cut") == 0, F.col("first"))).alias("full"),
        F.min(F.when(F.col("cut") > 0, F.col("first"))).alias("part"),
        F.map_from_entries(F.collect_list(F.when((F.col("cut") > 0) & (F.col("first") < F.col("last")), F.struct("cut", "first")))).alias("same"),
    )
    useful = by_key.filter((F.size("same") > 0) | (F.col("full").isNotNull() & F.col("part").isNotNull()))
    claim = F.when(F.col("cut") == 0, F.col("part")).otherwise(F.least("full", F.element_at("same", F.col("cut"))))
    claims = variants.join(useful, "key").select("h1", "h2", at.alias("own"), claim.alias("near")).filter(F.col("near") < F.col("own"))
    claims = claims.groupBy("h1", "h2").agg(F.min("near").alias("near"))
    return _verified(claims, worded.select("h1", "h2", F.split("body", " ", -1).alias("words")))


def _verified(claims: DataFrame, worded: DataFrame) -> DataFrame:
    """The claims whose two lines are one word edit apart."""
    mine = worded.select("h1", "h2", F.col("words").alias("a"))
    theirs = worded.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("words").alias("b"))
    both = claims.join(mine, ["h1", "h2"]).withColumn("n1", F.col("near.h1")).withColumn("n2", F.col("near.h2")).join(theirs, ["n1", "n2"])
    short, long = [F.when(F.size("a") <= F.size("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"))]
    both = both.withColumn("s", short).withColumn("l", long)
    size, more = F.size("s"), F.size("l") - F.size("s")
    differs = F.filter(F.sequence(F.lit(1), size), lambda i: ~F.get("s", i - 1).eqNullSafe(F.get("l", i - 1)))
    split = F.coalesce(F.get(differs, F.lit(0)), size + 1)
    rest = F.slice("s", split + F.when(more == 0, 1).otherwise(0), F.size("s")) == F.slice("l", split + 1, F.size("l"))
    return both.filter((more <= 1) & rest).select("h1", "h2", F.struct("near.doc", "near.line").alias("near"))


@finished("removed-lines")
def _removed(docs: DataFrame, min_chars: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, of, edits) as in `removed`, with places instead of ids."""
    found = lines(docs, id_col, text_col, min_chars)
    own = F.struct("doc", "line")
    known = hashed(found, min_words)
    first = earliest(known)
    near_lines = near(found, known, first)
    # Only lines that have a copy go back to all places: a narrow table, so a hot line's places can be split.
    again = known.groupBy("h1", "h2").agg(F.min(own).alias("first"), F.count("*").alias("n")).join(near_lines, ["h1", "h2"], "left")
    again = saved(again.filter((F.col("n") > 1) | F.col("near").isNotNull()).drop("n"), "again")
    rows = known.drop("halves").join(again, ["h1", "h2"]).filter((F.col("first") < own) | F.col("near").isNotNull())
    same = F.col("first") < own
    return rows.select("doc", "line", F.when(same, F.col("first")).otherwise(F.col("near")).alias("of"), F.when(same, 0).otherwise(1).alias("edits"))


def removed(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, of_doc, of_line, edits): every line that goes, with the earliest equal
    (edits 0) or else near (edits 1) line before it."""
    out = _removed(docs, min_chars, min_words, id_col, text_col)
    return out.select(F.col("doc.id").alias(id_col), "line", F.col("of.doc.id").alias("of_doc"), F.col("of.line").alias("of_line"), "edits")


def clean(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` without the removed lines.  A document that loses all its lines that hold a
    word goes; the others keep their rows.  `length_col` is set to the new length."""
    key, own, lost, kept = free(docs, "_key", "_own", "_gone", "_kept")
    gone = _removed(docs, min_chars, min_words, id_col, text_col).groupBy(F.col("doc").alias(key)).agg(F.collect_set("line").alias(lost))
    rows = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    joined = rows.join(gone, F.col(own) == F.col(key), "left")
    left = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(lost, i))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn(kept, text).filter(F.col(lost).isNull() | (F.trim(F.col(kept), F.lit(" \t\r\n")) != ""))
    out = out.withColumn(text_col, F.col(kept))
    if length_col:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
