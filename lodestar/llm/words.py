"""Vectorised words and word windows of many texts at once.

Texts are handled as UTF-8 bytes.  A fold table maps every byte to 0 (a separator)
or to one more than the byte it stands for, so lower-casing and splitting are one
table lookup.  Word hashes and window hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

BLOCK = 1 << 20


def _fold(separators: set[int], lower: bool) -> np.ndarray:
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[sorted(separators)] = 0
    return table


_BLANKS = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`
PLAIN = _fold(_BLANKS, lower=False)
#: the same after lower-casing A-Z
LOWER = _fold(_BLANKS, lower=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = _fold({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)
#: `[^\n]+`
LINES = _fold({0x0A}, lower=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _cut(raw: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end at a separator."""
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw):
            tail = np.flatnonzero(fold[raw[end : end + 4096]] == 0)
            if len(tail):
                end += int(tail[0])
                break
            end = min(end + 4096, len(raw))
        yield at, end
        at = end


def split(raw: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of the words of `raw`."""
    out = []
    for at, end in _cut(raw, fold):
        code = fold[raw[at:end]]
        word = np.zeros(len(code) + 2, dtype=np.int8)
        word[1:-1] = code != 0
        edge = np.flatnonzero(np.diff(word))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        code, size = code[code != 0], ends - starts
        first = np.cumsum(size) - size
        place = np.arange(len(code)) - np.repeat(first, size)
        value = _SYMBOL[code] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(2))
        hashes = mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((starts + at, ends + at, hashes))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Words:
    """The words of several texts, in order.  Text i has words first[i]:first[i + 1]."""

    data: bytes
    raw: np.ndarray
    begin: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of each window of n words within one text."""
        if len(self.hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = window_hash([self.hashes[j : len(self.hashes) - n + 1 + j] for j in range(n)])
        left = np.repeat(self.first[1:], self.count)[: len(total)]
        at = np.flatnonzero(np.arange(len(total)) + n <= left)
        return at, total[at]

    def rolling(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, word index, hash) of the windows of n = 1, 2, .. `longest` words within one text;
        each length takes in one more word of the sum that the length before it left."""
        left = np.repeat(self.first[1:], self.count)
        total = np.zeros(len(self.hashes), dtype=np.uint64)
        for n in range(1, longest + 1):
            total = _taken(total[: max(0, len(self.hashes) - n + 1)], self.hashes[n - 1 :])
            at = np.flatnonzero(np.arange(len(total)) + n <= left[: len(total)])
            yield n, at, mix(total[at] + np.uint64(n))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per text of a value for each word."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]


def window_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of n successive words; the order counts."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        total = _taken(total, part)
    return mix(total + np.uint64(len(parts)))


def _taken(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A running hash with one more word in it."""
    total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    return total


def words(texts: list[bytes | None], fold: np.ndarray) -> Words:
    """Splits texts; a null counts as an empty text."""
    texts = [x or b"" for x in texts]
    data = b"\n".join(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begin[1:])
    starts, ends, hashes = split(raw, fold)
    return Words(data, raw, begin, starts, ends, hashes, np.searchsorted(starts, begin))


def chunks(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows with about `budget` bytes of text, so that memory stays bounded."""
    texts = batch.column(column)
    sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= budget):
            size += sizes[end]
            end += 1
        yield at, end, texts.slice(at, end - at).cast(pa.binary()).to_pylist()
        at = end


def row_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element, how often its key occurs and how often it occurred before."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keys)))
    count, before = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
    count[order] = np.repeat(size, size)
    before[order] = np.arange(len(keys), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    return count, before
