"""Operator 11: fill-in-middle transformation.

A text is cut into units, runs of A-Z and a-z and every other character by itself, and two
of its unit boundaries part it into prefix, middle and suffix, which are put together anew
with marks between them.  Whether a unit begins at a character is told by this character
and the one before it.  So texts are cut into chunks that share that one byte with their
neighbour, the units of all chunks are counted side by side, running sums over a text's
chunks tell which chunk owns a cut, and only the owning chunks are read a second time.
Flags live for SLAB bytes at most, however long a text is.

Where the cuts fall and which form a text takes hangs on its id and the seed alone, so a
recomputed task gives the same rows.  Null texts count as empty ones, and a null id as the
empty string.  Texts without units, or that hold a mark, stay as they are (`plain`).
Repeated rows and ids give a row each, equal ids and texts equal rows; an empty table gives
no rows.  Other columns stay; own columns whose name is taken get underscores in front.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.llm import words as W
from lodestar.llm.storage import free

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk whose units are counted on their own.
CHUNK = 1 << 14
#: Bytes whose flags are in memory at once.
SLAB = 1 << 22
COLUMNS = ("n", "form", "prefix_chars", "middle_chars")
_KIND = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


class Chunks:
    """Chunks of several texts that lie end to end: text i is raw[begin[i]:begin[i + 1]].

    `units` and `points` are the units and code points before each chunk, over all texts.
    """

    def __init__(self, raw: np.ndarray, begin: np.ndarray, size: int | None = None):
        size = size or CHUNK
        self.raw, self.begin = raw, begin
        each = -(-np.diff(begin) // size)
        self.first = np.concatenate([[0], np.cumsum(each)])
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], each)
        self.edge = np.append(np.repeat(begin[:-1], each) + place * size, begin[-1])
        units, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at, last = 0, len(self.edge) - 1
        while at < last:
            end = max(at + 1, int(np.searchsorted(self.edge, self.edge[at] + SLAB, "right")) - 1)
            starts, whole = self.flags(at, end)
            cuts = self.edge[at:end] - self.edge[at]
            units.append(np.add.reduceat(starts, cuts, dtype=np.int64))
            points.append(np.add.reduceat(whole, cuts, dtype=np.int64))
            at = end
        self.units, self.points = np.cumsum(np.concatenate(units)), np.cumsum(np.concatenate(points))

    def flags(self, chunk: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes of chunks `chunk` to `end`: which begin a unit, and which a code point.

        The byte before the first is read too; at the begin of a text it has no say."""
        low, high = self.edge[chunk], self.edge[end]
        own = self.raw[low:high]
        letter = ((self.raw[max(low - 1, 0) : high] | 0x20) - np.uint8(0x61)) < 26
        letter = letter if low else np.concatenate([[False], letter])
        whole = (own & 0xC0) != 0x80
        starts = whole & ~(letter[1:] & letter[:-1])
        text = np.searchsorted(self.begin, [low, high])
        new = self.begin[text[0] : text[1]] - low
        starts[new[new < len(starts)]] = True
        return starts, whole

    def count(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and code points of a text before its unit number `rank`; behind the last one: all."""
        a, b = self.first[text], self.first[text + 1]
        wanted = self.units[a] + rank
        if wanted >= self.units[b]:
            return int(self.begin[text + 1] - self.begin[text]), int(self.points[b] - self.points[a])
        owner = int(np.searchsorted(self.units[a : b + 1], wanted, "right")) - 1 + a
        starts, whole = self.flags(owner, owner + 1)
        at = int(np.flatnonzero(starts)[wanted - self.units[owner]])
        return int(self.edge[owner] - self.begin[text]) + at, int(self.points[owner] - self.points[a] + np.count_nonzero(whole[:at]))


def parts(texts: list[bytes], draws: np.ndarray, rate: int, spm: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of every text, from four draws for each."""
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    chunks = Chunks(np.frombuffer(b"".join(texts), np.uint8), begin)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for i, (text, n, (h1, h2, h3, h4)) in enumerate(zip(texts, chunks.count().tolist(), draws.tolist())):
        if not text or h3 % 100 >= rate or p in text or s in text or m in text:
            out.append((n, "plain", None, None, text))
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        (x, before), (y, upto) = chunks.cut(i, a), chunks.cut(i, b)
        if h4 % 100 < spm:
            out.append((n, "spm", before, upto - before, b"".join((s, text[y:], p, text[:x], m, text[x:y]))))
        else:
            out.append((n, "psm", before, upto - before, b"".join((p, text[:x], s, text[y:], m, text[x:y]))))
    return out


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with their texts put together anew, and n, form, prefix_chars and middle_chars.

    `rate` of 100 texts are changed, and of these `spm` of 100 take the form that begins
    with the suffix.  Draws are the first four groups of eight hex digits of the sha256 of
    `seed:id`.  One narrow pass, in Arrow batches.
    """

    @F.arrow_udf(_KIND)
    def changed(text: pa.Array, *draws: pa.Array) -> pa.Array:
        drawn = np.stack([d.to_numpy(zero_copy_only=False) for d in draws], axis=1) if len(text) else np.zeros((0, 4), np.int64)
        columns: list[list[pa.Array]] = [[] for _ in _KIND]
        for at, end, texts in W.chunks(pa.RecordBatch.from_arrays([text], names=["t"]), "t", SLAB):
            done = zip(*parts([t or b"" for t in texts], drawn[at:end], rate, spm))
            for column, values, kind in zip(columns, done, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())):
                column.append(pa.array(values, kind))
        joined = [pa.concat_arrays(c) if c else pa.array([], kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.StructArray.from_arrays([*joined[:4], joined[4].cast(pa.string())], names=_KIND.names)

    own, key = free(docs, "_fim", "_key")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(F.col(key), 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    out = docs.withColumn(key, digest).withColumn(own, changed(F.col(text_col), *draws))
    rest = [F.col(own)["output"].alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*rest, *[F.col(own)[c].alias(name) for c, name in zip(COLUMNS, free(docs, *COLUMNS))])


def restored(output: Column | str, form: Column | str) -> Column:
    """The exact text from what `fill_in_middle` made of it.

    No text that was changed holds a mark, and marks begin and end with characters that
    cannot overlap, so the first three marks are those that were put in."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(piece[1], piece[3], piece[2]), F.concat(piece[2], piece[3], piece[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
