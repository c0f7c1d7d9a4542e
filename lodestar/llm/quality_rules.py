"""Operator 4: quality rules by repetition coverage.

Word n-grams of several lengths are hashed in numpy, each length from the running hash of
the one before; a document is judged by the share of its characters that lies inside
repeated n-grams and repeated lines.  The scan is narrow: no shuffle, and memory is
bounded by 1 MB of texts at a time, or by one text that is longer.

Null and empty texts have no words and fail the base rule.  Ties, repeated rows and
repeated ids are judged row by row; an empty table gives no rows; columns other than the
two named are not read, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm import words as W
from lodestar.llm.storage import free

#: n -> most percent of word characters that the most frequent n-gram may hold
TOP_GRAMS = {2: 20, 3: 18, 4: 16}
#: n -> most percent of word characters inside n-grams that occurred before
REPEATED_GRAMS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_words_pct: int = 50
    max_dup_lines_pct: int = 30
    max_dup_line_chars_pct: int = 20
    max_symbols_pct_of_words: int = 20


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_repeat_words"]
_GRAMS = [*(f"top_{n}_chars" for n in TOP_GRAMS), *(f"rep_{n}_chars" for n in REPEATED_GRAMS)]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are measured at once; a longer text is measured alone.
BLOCK = 1 << 20


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of x before each place; texts of one call have less than 2^31 bytes."""
    out = np.zeros(len(x) + 1, dtype=np.int32)
    np.cumsum(x, out=out[1:], dtype=np.int32)
    return out


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of each text, as columns."""
    w = W.words(texts, W.PLAIN)
    n, text = len(texts), w.text.astype(np.int32)
    lead = _running((w.raw & 0xC0) != 0x80)
    chars = lead[w.ends] - lead[w.starts]
    symbols, edge = _running(_SYMBOLS[w.raw]), np.minimum(w.begin, len(w.raw))
    out = {"n_words": w.count, "word_chars": w.sums(chars), "n_symbols": symbols[edge[1:]] - symbols[edge[:-1]]}

    starts, ends, hashes = W.split(w.raw, W.LINES)
    holds = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, hashes = starts[holds], ends[holds], hashes[holds]
    of = np.searchsorted(w.begin, starts, side="right") - 1
    _, before = W.row_counts(W.mix(hashes + of.astype(np.uint64) * _SPREAD))
    long = lead[ends] - lead[starts]
    add = lambda v: np.bincount(of, weights=v, minlength=n).astype(np.int64)
    out |= {"n_lines": add(np.ones(len(of))), "n_dup_lines": add(before > 0), "line_chars": add(long), "dup_line_chars": add(long * (before > 0))}
    del lead, symbols

    upto, alive = _running(chars), None
    for k, at, h in w.rolling(max(REPEATED_GRAMS)):
        if k == 1:
            continue
        if alive is not None:  # a repeated window has repeated parts
            keep = alive[at] & alive[at + 1]
            at, h = at[keep], h[keep]
        count, before = W.row_counts(W.mix(h + text[at].astype(np.uint64) * _SPREAD))
        rep = at[count > 1]
        alive = np.zeros(len(text) + 1, dtype=bool)
        alive[rep] = True
        if k in TOP_GRAMS:
            top = np.zeros(n, dtype=np.int64)
            np.maximum.at(top, text[rep], count[count > 1].astype(np.int64) * (upto[rep + k] - upto[rep]))
            out[f"top_{k}_chars"] = top
        if k == 3:
            out["n_repeat_words"] = w.sums(_covered(rep, k, len(text)))
        if k in REPEATED_GRAMS:
            out[f"rep_{k}_chars"] = w.sums(chars * _covered(at[before > 0], k, len(text)))
    return {c: out[c] for c in [*_COLUMNS, *_GRAMS]}


def _covered(at: np.ndarray, k: int, size: int) -> np.ndarray:
    """Which words are in a window of k words that starts at one of `at` (each at most once)."""
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[at] += 1
    edge[at + k] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def counts(text: Column) -> Column:
    """The repetition counts of a text as a struct (Arrow batches)."""
    kind = StructType([StructField(c, LongType()) for c in [*_COLUMNS, *_GRAMS]])

    @F.arrow_udf(kind)
    def measured(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["t"])
        parts = [measure(texts) for _, _, texts in W.chunks(batch, "t", BLOCK)] or [measure([])]
        columns = [pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in kind.names]
        return pa.StructArray.from_arrays(columns, names=kind.names)

    return measured(text)


def _verdict(m: str, rules: Rules) -> tuple[Column, dict[str, Column]]:
    """Whether the base rule fails, and the other rules that are broken, from counts in column `m`."""
    c = F.col(m).getField
    base = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_words_pct * c("n_words"))
    broken = {
        "dup_lines": 100 * c("n_dup_lines") > rules.max_dup_lines_pct * c("n_lines"),
        "dup_line_chars": 100 * c("dup_line_chars") > rules.max_dup_line_chars_pct * c("line_chars"),
        "symbols": 100 * c("n_symbols") > rules.max_symbols_pct_of_words * c("n_words"),
    }
    broken |= {f"top_{n}": 100 * c(f"top_{n}_chars") > p * c("word_chars") for n, p in TOP_GRAMS.items()}
    broken |= {f"rep_{n}": 100 * c(f"rep_{n}_chars") > p * c("word_chars") for n, p in REPEATED_GRAMS.items()}
    return base, broken


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row with base_failed, kept and the names of the rules broken."""
    rows = docs.select(F.col(id_col).alias("_id"), counts(F.col(text_col)).alias("_m"))
    base, broken = _verdict("_m", rules)
    named = F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in broken.items()])
    out = rows.select(F.col("_id").alias(id_col), "_m.*", base.alias("base_failed"), named.alias("broken"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def filter_documents(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, in one narrow scan.

    The counts travel beside the row, so no join brings them back together, and rows that
    share an id are judged each by itself.
    """
    (m,) = free(docs, "_m")
    base, broken = _verdict(m, rules)
    return docs.withColumn(m, counts(F.col(text_col))).filter(~reduce(or_, broken.values(), base)).select(docs.columns)
