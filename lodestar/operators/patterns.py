"""Many keys in many texts: one Aho-Corasick automaton, one scan of each text.

The keys are collected in blocks of BLOCK_BYTES, a bound on what is broadcast; each task
builds the automaton of a block once and keeps it in its worker for the tasks that follow.
A dictionary of one block is a column of the scan itself; a larger one takes a scan for
each block, whose finds meet by row.  The time of a scan grows with the text and its hits,
not with the number of keys.  Empty and null keys are left out, null texts hold none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keys in one automaton; its nodes take some forty times as much.
BLOCK_BYTES = 2 << 20
#: The automaton that this worker built last, by the dictionary's token.
_built: dict = {}


def _automaton(token: str, keys: list[str]) -> ahocorasick.Automaton:
    if token not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            a.add_word(k, i)
        a.make_automaton()
        _built[token] = a
    return _built[token]


def _hits(automaton: ahocorasick.Automaton, text: str | None) -> set[int]:
    return {i for _, i in automaton.iter(text)} if text and len(automaton) else set()


def _blocks(keys: DataFrame, key_col: str) -> Iterator[list[str]]:
    """The distinct keys, sorted, in as many blocks as BLOCK_BYTES asks for; one block at least."""
    known = keys.select(F.col(key_col).alias("key")).filter("key IS NOT NULL AND key <> ''").distinct()
    n = max(1, -(-(known.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) // BLOCK_BYTES))
    for b in range(n):
        yield sorted(known.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b).toArrow().column("key").to_pylist())


def scanner(rows: DataFrame, keys: list[str], pick: Callable[[set[str]], list[str]] = sorted) -> Callable[[Column], Column]:
    """A column function: what `pick` makes of the keys that a text holds, by default all in order."""
    shared, token = rows.sparkSession.sparkContext.broadcast(keys), uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        known = shared.value
        automaton = _automaton(token, known)
        return pa.array([pick({known[i] for i in _hits(automaton, t)}) for t in text.to_pylist()], pa.list_(pa.string()))

    return found


def contained(rows: DataFrame, keys: DataFrame, id_col: str, text: Column, key_col: str = "key") -> DataFrame:
    """(id, key): every distinct key of `keys` in the text of each row."""
    out = None
    for block in _blocks(keys, key_col):
        found = rows.select(F.col(id_col), F.explode(scanner(rows, block)(text)).alias("key"))
        out = found if out is None else out.unionByName(found)
    return out


def longest(rows: DataFrame, keys: DataFrame, id_col: str, text: Column, key_col: str = "key") -> DataFrame:
    """(id, key): the longest key in each row's text, of equal lengths the least; rows without one give none."""
    first = F.min_by("key", F.struct((-F.char_length("key")).alias("n"), F.col("key").alias("k"))).alias("key")
    return contained(rows, keys, id_col, text, key_col).groupBy(id_col).agg(first)


def synonyms(rows: DataFrame, pairs: DataFrame, text_col: str, out: str, most: int = 5) -> DataFrame:
    """`rows` with the words whose key the text holds and that it lacks itself: in order of their keys, at most `most`.

    pairs: (key, word).  One scan finds keys and words alike.  The pairs of a synonym
    dictionary are kept by the driver, one block of keys; more than that is an error.
    """
    known = pairs.select("key", "word").filter("key <> '' AND word <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("key") + F.octet_length("word") + 32)).first()[0] or 0
    if size > 2 * BLOCK_BYTES:
        raise ValueError(f"a synonym dictionary of {size} bytes; {2 * BLOCK_BYTES} are the most")
    both = sorted((r["key"], r["word"]) for r in known.collect())
    by_key: dict[str, list[str]] = {}
    for k, w in both:
        by_key.setdefault(k, []).append(w)
    pick = lambda have: [w for k in sorted(have & by_key.keys()) for w in by_key[k] if w not in have][:most]
    return rows.withColumn(out, scanner(rows, sorted({x for p in both for x in p}), pick)(F.col(text_col)))
