"""Operators 5 and 7: token counts, and BPE encoding and decoding, for a word-end BPE.

Both read the tokenizer file that `public_tokenizers.path(name)` names; nothing is
trained.  Texts are normalised and cut into pre-tokens as the file says; texts with
characters outside the plain ranges below are cut by the library itself, so that its
Unicode tables hold.  Special strings inside a text become special tokens.

Null and empty texts have no tokens.  Texts are taken whole, however long: a block of texts
ends after a megabyte or one text.  Repeated rows and ids are encoded row by row, ties in rank
go from left to right, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words as W

MODEL = "word_bpe_49k.json"
#: Entries of the broadcast table of frequent pre-tokens: a few MB.
TABLE_SIZE = 65_536
#: Rows of each input split that the table is made from.
SPLIT_ROWS = 200
#: Entries that a cache holds before it starts anew.
CACHE_SIZE = 150_000
#: Counts that a worker keeps besides the table: some 50 MB.
COUNTS = 400_000
#: Tokens whose pieces a task remembers.
SPINES = 16_384

#: Characters that NFC leaves alone and whose lower case is one of them again.
_PLAIN = [c for c in range(0x250) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250] + [*range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
_SPACE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}


def _class(codes: Iterable[int]) -> str:
    return "".join(f"\\u{c:04x}" for c in codes)


_L = _class(c for c in _PLAIN if unicodedata.category(chr(c))[0] == "L")
_N = _class(c for c in _PLAIN if unicodedata.category(chr(c))[0] == "N")
_S = _class(sorted(_SPACE))
_ODD = re.compile(f"[^{_class(_PLAIN)}]")
#: The pre-token pattern of the file, for plain characters.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(name: str = MODEL):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _bytes_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cutter:
    """Pre-tokens of a text; special tokens come as their id."""

    def __init__(self, name: str = MODEL):
        self.tok = library(name)
        spec = json.loads(open(path(name), encoding="utf-8").read())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.part = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str | int]:
        if self.part is None or "<|" not in text or not self.part.search(text):
            return self._plain(text)
        out: list[str | int] = []
        for k, part in enumerate(self.part.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _PIECE.findall(text.lower())
        text, byte = self.tok.normalizer.normalize_str(text), _bytes_of()
        return [bytes(byte[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]


class _Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, and over it what this worker has met besides.

    What is missing goes to the file's model alone, past its normaliser and cutter: a
    pre-token is normalised already, and normalising it again may change it."""

    def __init__(self, table: dict[str, int], name: str):
        super().__init__(table)
        self.table, self.model = table, library(name).model
        self.letter = {b: c for c, b in _bytes_of().items()}

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join([self.letter[b] for b in piece.encode("utf-8", "surrogateescape")])
        return len(self.model.tokenize(piece))

    def counts(self, pieces: list[list[str | int]]) -> list[int]:
        """Tokens of each text, given its pre-tokens."""
        found = [list(map(self.get, p)) for p in pieces]
        new = {x for p, n in zip(pieces, found) if None in n for x, k in zip(p, n) if k is None}
        if not new:
            return list(map(sum, found))
        if len(self) + len(new) > COUNTS + len(self.table):
            self.clear()
            self.update(self.table)
            new = set(chain.from_iterable(pieces)).difference(self)
        self.update((p, self.count(p) if isinstance(p, str) else 1) for p in new)  # a number is a special token
        return [sum(map(self.__getitem__, p)) if None in n else sum(n) for p, n in zip(pieces, found)]


#: This worker's counts, by the token of the table under them: kept from task to task, for one table at a time.
_lengths: dict[str, _Lengths] = {}


def _lengths_of(token: str, table: dict[str, int], name: str) -> _Lengths:
    if token not in _lengths:
        _lengths.clear()
        _lengths[token] = _Lengths(table, name)
    return _lengths[token]


def frequent(docs: DataFrame, text_col: str = "text", name: str = MODEL, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of frequent pre-tokens: `size` of them at most.

    They come from the first SPLIT_ROWS rows of every input split, so from all over the
    corpus; a task hands on its share of the table, most frequent first, and nothing is
    shuffled.  The table only saves time: what it lacks is counted where it occurs, so no
    count depends on which rows it saw.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = docs.select(F.col(text_col).alias("_text"), place.alias("_place")).filter(F.col("_place") < SPLIT_ROWS).select("_text")
    share = max(1, size // max(1, rows.rdd.getNumPartitions()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Cutter(name), Counter()
        for batch in batches:
            for _, _, texts in W.chunks(batch, "_text"):
                for t in texts:
                    if t:
                        seen.update(p for p in cut.pieces(t.decode()) if isinstance(p, str))
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in seen.most_common(share)], pa.string())})

    found = {r["piece"] for r in rows.mapInArrow(count, "piece string").limit(size).collect()}
    counts = _Lengths({}, name)
    return {piece: counts.count(piece) for piece in found}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = MODEL, limit: int = 2048) -> DataFrame:
    """For every row: id, n_bytes, n_tokens and whether there are more than `limit` tokens."""
    shared, token = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, name)), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, lengths = Cutter(name), _lengths_of(token, shared.value, name)
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text", 1 << 20):
                n = lengths.counts([cut.pieces(t.decode()) if t else [] for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, end - at), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class Merges:
    """The file's merges, and which token may follow which.

    A word is its bytes; the last one carries the word end.  Tokens are kept as bytes
    in two tables: those inside a word and those that end one.
    """

    def __init__(self, name: str = MODEL):
        spec = json.loads(open(path(name), encoding="utf-8").read())
        model, byte, self.end = spec["model"], _bytes_of(), spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.letter = {b: c for c, b in byte.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.inner: dict[bytes, str] = {}
        self.final: dict[bytes, str] = {}
        for t in self.vocab:
            stem, table = (t[: -len(self.end)], self.final) if t.endswith(self.end) and t != self.end else (t, self.inner)
            if stem and all(c in byte for c in stem):
                table[bytes(byte[c] for c in stem)] = t
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.known: dict[tuple[str, str], bool] = {}
        self.uneven: set[str] = set()
        self.spine = lru_cache(SPINES)(self._spine)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return [*token]

    def plain(self, parts: list[str]) -> list[str]:
        """Merging by rank, lowest first: what the traversal must agree with."""
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def _spine(self, token: str, last: bool) -> list[tuple[str, int, int]]:
        """The pieces at a token's end (or start) while it is merged: (piece, rank that formed
        it, rank that took it).  Empty for a token that merging does not give back; a token
        whose ranks do not grow while it is merged is noted in `uneven`."""
        parts, out, before = self._symbols(token), [], -1
        out.append((parts[-1 if last else 0], -1))
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            if rank < before:
                self.uneven.add(token)
            before = rank
            if i == (len(parts) - 2 if last else 0):
                out.append((parts[i] + parts[i + 1], rank))
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        ends = [r for _, r in out[1:]] + [1 << 60]
        return [(p, r, e) for (p, r), e in zip(out, ends)] if parts == [token] else []

    def fits(self, before: str, token: str) -> bool:
        """Whether the two stay two tokens when they meet; `before` may be "" (a word's start).

        Where ranks only grow while both are merged, pieces at the seam meet when both are
        formed and neither is taken yet; equal ranks go from left to right.  Elsewhere the
        two are merged as one word.
        """
        if not before:
            return before == "" and bool(self.spine(token, False))
        key = (before, token)
        got = self.known.get(key)
        if got is None:
            ranks, right = self.ranks, self.spine(token, False)
            left = self.spine(before, True)
            if before in self.uneven or token in self.uneven:
                got = self.plain(self._symbols(before) + self._symbols(token)) == [before, token]
            else:
                got = bool(left and right) and not any((r := ranks.get((a, b), -1)) > fa and r > fb and r < ta and r <= tb for a, fa, ta in left for b, fb, tb in right)
            if len(self.known) >= CACHE_SIZE:
                self.known.clear()
            self.known[key] = got
        return got

    def encode(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of distinct pre-tokens.

        The sorted words are the depth-first order of their trie.  `states` holds for
        each prefix on the path its last token and where that token starts; a word goes
        on from the prefix that it shares with the word before it.  A word that no chain of
        tokens reaches is merged plainly.
        """
        out, states, last = {}, [("", 0)], b""
        inner, final, longest, fits, vocab = self.inner, self.final, self.longest, self.fits, self.vocab
        for word, piece in sorted((p.encode("utf-8", "surrogateescape"), p) for p in pieces):
            body = len(word) - 1
            shared = len(os.path.commonprefix((last, word[:body])))
            del states[shared + 1 :]
            for end in range(len(states), body + 1):
                for at in range(max(0, end - longest), end):
                    token = inner.get(word[at:end])
                    if token is not None and fits(states[at][0], token):
                        states.append((token, at))
                        break
                else:
                    states.append((None, 0))
            last = word[:body]
            for at in range(max(0, body + 1 - longest), body + 1):
                token = final.get(word[at:])
                if token is not None and fits(states[at][0], token):
                    ids = [vocab[token]]
                    while at:
                        token, at = states[at]
                        ids.append(vocab[token])
                    out[piece] = tuple(reversed(ids))
                    break
            else:
                letters = [self.letter[b] for b in word]
                out[piece] = tuple(vocab[t] for t in self.plain([*letters[:-1], letters[-1] + self.end]))
        return out


class Encodings:
    """The encodings of the pre-tokens that a worker has met: places in one flat array of ids."""

    def __init__(self, name: str = MODEL):
        self.bpe = Merges(name)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str | int, int] = {}
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def _thin(self, most: int) -> None:
        """Keeps the pre-tokens met twice or more since the last time, the `most` most frequent of them."""
        kept = np.flatnonzero(self.used > 1)
        kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[:most]])
        names, sizes = list(self.place), np.diff(self.start)[kept]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = self.ids[np.arange(upto[-1]) + np.repeat(self.start[kept] - upto[:-1], sizes)]
        self.start, self.place = upto, {names[k]: i for i, k in enumerate(kept.tolist())}
        self.used = np.zeros(len(kept), np.int64)

    def _learn(self, pieces: set[str | int]) -> None:
        found = self.bpe.encode(p for p in pieces if isinstance(p, str))
        found.update((p, (p,)) for p in pieces if isinstance(p, int))  # special tokens
        first = len(self.place)
        self.place.update((p, first + k) for k, p in enumerate(found))
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found.values()), np.int32, int(sizes.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def encode(self, pieces: list[list[str | int]]) -> pa.ListArray:
        """The ids of each text, given its pre-tokens."""
        new = set(chain.from_iterable(pieces)).difference(self.place)
        if len(self.place) + len(new) > CACHE_SIZE:
            self._thin(CACHE_SIZE // 2)
            new = set(chain.from_iterable(pieces)).difference(self.place)
            if len(self.place) + len(new) > CACHE_SIZE:
                self.clear()
                new = set(chain.from_iterable(pieces))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64)
        self.used = np.bincount(at, minlength=len(self.place)) + np.pad(self.used, (0, len(self.place) - len(self.used)))
        sizes = self.start[at + 1] - self.start[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(upto[-1]) + np.repeat(self.start[at] - upto[:-1], sizes)]
        offsets = upto[np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


@cache
def _encodings(name: str) -> Encodings:
    """A worker's encodings, kept from task to task; CACHE_SIZE bounds them."""
    return Encodings(name)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = MODEL, decoded: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's whole text, without special tokens of the tokenizer's own.

    `decoded` names a further column: what `decode` makes of the ids, in the same worker.
    Tables and encodings are kept from task to task, bounded by CACHE_SIZE."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = Cutter(name), _encodings(name)
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text", 1 << 20):
                ids = known.encode([cut.pieces(t.decode()) if t else [] for t in texts])
                back = [] if decoded is None else [_texts(ids, name)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, end - at), ids, *back], names=["_id", "ids", "_text"][: 2 + len(back)])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, ids array<int>" + (", _text string" if decoded else ""))
    return out.withColumnsRenamed({"_id": id_col} | ({"_text": decoded} if decoded else {}))


@cache
def _names(name: str) -> pa.Array:
    """The token of every id; null where the vocabulary has none."""
    spec = json.loads(open(path(name), encoding="utf-8").read())
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def _texts(ids: pa.Array, name: str) -> pa.Array:
    """The text of each list of ids."""
    names = _names(name)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    known = (flat >= 0) & (flat < len(names))
    known[known] = names.is_valid().to_numpy(zero_copy_only=False)[flat[known]]
    if not known.all():
        offsets, flat = np.concatenate([[0], np.cumsum(known)])[offsets], flat[known]
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(flat)))
    return pa.compute.if_else(ids.is_valid(), pa.compute.binary_join(tokens, " "), None)


def decode(ids: str = "ids", name: str = MODEL) -> Column:
    """The text of an array of ids, as the library gives it with special tokens: the file
    names no decoder, so tokens are joined by one blank.  A null array stays null; a null
    or an id that the vocabulary lacks is left out, as the library does."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return _texts(ids, name)

    return text(F.col(ids))


def digests(encoded: DataFrame, id_col: str = "doc_id", decoded: str = "decoded") -> DataFrame:
    """Counts and hashes of what `encode` gave, ids and decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
