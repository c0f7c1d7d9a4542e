"""Operator 9: personal data.

Regular expressions propose spans, checksum validators (Luhn, mod-97) and ranges
confirm them, and context words nearby move the score.  Spans of the four base kinds
stay whatever their score; spans of the added kinds need `min_score`.  Offsets are
code points, the end is exclusive.

Null and empty texts have no spans, an empty table gives no rows.  Rows are scanned one by
one, whole, in one narrow pass, in a time that grows with the length of the text: no
pattern starts anew inside a run that it has seen.  Spans of different kinds may overlap
and all stand in the result; of one kind they do not.  Repeated rows and ids give a row
each; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words as W

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "secret")
CONTEXT_CHARS = 48
MIN_SCORE = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts where a run of digits does: from within the run the same would follow.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-]*[0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:[a-f0-9]{32,64}|[A-F0-9]{32,64}|[A-Z]{4}[A-Z0-9]{16}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9_])")
_CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write|@"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server"),
    "card": re.compile(r"(?i)card|visa|master|credit|karte|tarjeta|carte"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "ssn": re.compile(r"(?i)\bssn\b|social|security"),
    "local_phone": re.compile(r"(?i)phone|tel|call|mobile|fax|handy"),
    "secret": re.compile(r"(?i)token|key|secret|passw|bearer|api"),
}


def luhn(digits: str) -> bool:
    """The Luhn checksum over decimal digits."""
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 mod-97 checksum of an IBAN without blanks."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _matches(pattern: re.Pattern, valid: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    def scan(text: str) -> Iterator[tuple[int, int]]:
        for m in pattern.finditer(text):
            if valid(m[0]):
                yield m.span()

    return scan


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


# The length of an IBAN by country, as the public registry lists it.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 "
        "RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
    ).split()
}


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs that have their country's length and pass mod-97; of other countries, whole runs that pass."""
    for m in _IBAN.finditer(text):
        s, seen = m[0], 0
        size = IBAN_LENGTHS.get(s[:2], len(s.replace(" ", "")))
        for end, c in enumerate(s, 1):
            seen += c != " "
            if seen == size:
                if (end == len(s) or s[end] == " ") and mod97(s[:end].replace(" ", "")):
                    yield m.start(), m.start() + end
                break


_SCAN: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails,
    "ip": _matches(_IP, lambda s: all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in s.split("."))),
    "card": _matches(_CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _matches(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    "iban": ibans,
    "ssn": _matches(_SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
    "local_phone": _matches(_LOCAL_PHONE, lambda s: 9 <= len(_digits(s)) <= 12),
    "secret": _matches(_SECRET, lambda s: len(set(s)) > 8),
}
#: A validated span's score before its context is read.
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.5, "local_phone": 0.3, "secret": 0.4}
_RAISE = {"local_phone": 0.4}


def spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start."""
    out = []
    for kind, scan in _SCAN.items():
        for start, end in scan(text):
            near = text[max(0, start - CONTEXT_CHARS) : start] + "\x00" + text[end : end + CONTEXT_CHARS // 2]
            score = min(1.0, _START[kind] + (_RAISE.get(kind, 0.25) if _CONTEXT[kind].search(near) else 0.0))
            if kind in BASE or score >= min_score:
                out.append((kind, start, end, round(score, 2)))
    return out


def find(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id and spans array<struct<kind, start, end, score>>."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in W.chunks(batch, "_text"):
                found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t.decode(), min_score)] if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, end - at), pa.array(found, kind)], names=["_id", "spans"])

    return rows.mapInArrow(scan, f"_id {rows.schema['_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>").withColumnRenamed("_id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what `find` gave."""
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("bigint")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    counts = [[of(k).alias(f"n_{k}") for k in kinds] for kinds in (BASE, ADDED)]
    return found.select(id_col, *counts[0], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"), *counts[1])


def masked(text: str, found: Column | str = "spans") -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans as one."""

    @F.arrow_udf("string")
    def mask(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), spans.to_pylist()):
            if t is not None:
                parts, done = [], 0
                for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        parts += [t[done : s["start"]], f"<{s['kind']}>"]
                    done = max(done, s["end"])
                t = "".join(parts) + t[done:]
            out.append(t)
        return pa.array(out, pa.string())

    return mask(F.col(text), F.col(found) if isinstance(found, str) else found)
