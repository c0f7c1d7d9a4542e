"""Operator 12: WARC archives, written and read by a data source that salvages.

`spark.write.format("warc")` writes one gzip member for every record.  Each task writes
archives of its own into the folder, and the manifest that the commit leaves names those of
the tasks that counted, so a task that is run again leaves nothing double.  The manifest
also holds record offsets SPLIT bytes apart; a reader's partition lies between two of them.

`spark.read.format("warc")` checks every record: the member inflates and its checksum
holds, the version line, headers and lengths fit, the block ends where it should, and its
digests hold.  Where a check fails the reader searches on for the next gzip member or
version line that begins a valid record, goes on from there, and gives the bytes between as
a row with `fault` set: the log of what is quarantined.  Archives of other writers, plain
or compressed, are read too, one partition for each file where there is no manifest.

A partition holds one record at a time in memory, of MAX_RECORD bytes at most; a longer one
is quarantined, with that reason.  Null payloads are empty ones, a null id has a record id
of its own kind, and a null url gives no target.  Repeated rows give a record each.  An
empty table gives a folder without archives, and reading that no rows.  Only the columns
that are named are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestar.llm.storage import saved

#: Bytes of archive between the offsets that part the reader's partitions.
SPLIT = 32 << 20
#: Bytes of an archive before a task begins another.
ARCHIVE = 1 << 30
#: Bytes of the longest record that is read.
MAX_RECORD = 1 << 30
#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Most digests that are broadcast: 6 MB.  More are joined, in SALTS parts for each digest.
MAX_BROADCAST = 100_000
SALTS = 64
PIECE = 1 << 18
MANIFEST = "_manifest.json"
DATE = "2024-01-01T00:00:00Z"
# Names of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

SCHEMA = (
    "archive string, start bigint, length bigint, fault string, record_type string, record_id string, target_uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary, headers map<string,string>"
)
_ARROW = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("fault", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())),
])


class Fault(Exception):
    """A check that a record fails."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None
    digest: str | None
    size: int | None


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), urlsplit(path).path if path.startswith("file:") else path


# Writing


def urn(key: str | None) -> str:
    """The record id of a row's id."""
    return "<urn:lodestar:none>" if key is None else f"<urn:lodestar:id:{quote(key, safe='')}>"


def key_of(record_id: str | None) -> str | None:
    """The row's id in a record id that `urn` made."""
    m = re.fullmatch(r"<urn:lodestar:id:(.*)>", record_id or "")
    return unquote(m[1]) if m else None


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit of the response that `refers_to` names, without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(key)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    """The data as one gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Rows (key string, url string, payload binary, refers_to string) as records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compressed = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for row in zip(*(batch.column(c) for c in ("key", "url", "payload", "refers_to"))):
                    key, url, payload, refers_to = (x.as_py() for x in row)
                    if out is not None and files[-1]["bytes"] >= ARCHIVE:
                        out.close()
                        out = None
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
                        files.append({"name": name, "bytes": 0, "marks": []})
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    file = files[-1]
                    if file["bytes"] >= SPLIT + (file["marks"] or [0])[-1]:
                        file["marks"].append(file["bytes"])
                    data = record(key, url, payload or b"", refers_to, self.date)
                    file["bytes"] += out.write(member(data) if self.compressed else data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files = [] if self.overwrite else _manifest(store, path) or []
        with store.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files + [f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{path}/{f['name']}")


def _manifest(store: pa.fs.FileSystem, path: str) -> list[dict] | None:
    if store.get_file_info(f"{path}/{MANIFEST}").type == pa.fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


# Reading


Get = Callable[[int, int], bytes]
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Fault("a header line without a colon")
        if not _NAME.fullmatch(name):
            raise Fault("a header that is no name")
        last = name.decode().lower()
        if last in out and last != "warc-concurrent-to":
            raise Fault("a header that occurs twice")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _checked(label: str, said: str | None, data: bytes) -> None:
    algorithm, colon, value = (said or "").partition(":")
    if colon and algorithm.lower() in ("sha256", "sha-256") and value.lower() != hashlib.sha256(data).hexdigest():
        raise Fault(f"the {label} digest fails")


def parsed(get: Get, at: int) -> tuple[Record, int]:
    """The record whose version line is at `at`, and where the next one begins."""
    if not re.match(rb"WARC/1\.[01]\r\n", get(at, 10)):
        raise Fault("no version line")
    head, size = b"", 1 << 12
    while END not in head:
        more = get(at + 10, size)
        if len(more) == len(head) or size > 1 << 20:
            raise Fault("headers without an end")
        head, size = more, size * 4
    head = head[: head.index(END)]
    if b"\r\nWARC/1." in head or head.startswith(b"WARC/1."):
        raise Fault("headers that run into another version line")
    fields = _fields(head)
    if missing := [k for k in _NEEDED if k not in fields]:
        raise Fault(f"no header {missing[0]}")
    if not re.fullmatch(r"[0-9]{1,18}", length := fields["content-length"]):
        raise Fault("no content length")
    if int(length) > MAX_RECORD:
        raise Fault("a record over the longest size")
    begin = at + 10 + len(head) + 4
    block = get(begin, int(length) + 4)
    if len(block) < int(length) + 4:
        raise Fault("a block cut short")
    if block[-4:] != END:
        raise Fault("a block of another length")
    block = block[:-4]
    _checked("block", fields.get("warc-block-digest"), block)
    said, size, payload = fields.get("warc-payload-digest"), len(block), block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(END)
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
        size = int(stated[1]) if stated else None
    if fields.get("warc-type") == "revisit":
        return Record(fields, None, said.partition(":")[2] if said else None, size), begin + int(length) + 4
    _checked("payload", said, payload)
    return Record(fields, payload, hashlib.sha256(payload).hexdigest(), len(payload)), begin + int(length) + 4


def inflated(get: Get, at: int) -> tuple[bytes, int]:
    """The contents of the gzip member at `at`, its checksum verified, and where it ends."""
    z, out, size, asked = zlib.decompressobj(31), [], 0, 1 << 13
    try:
        while not z.eof:
            piece, asked = get(at, asked), min(2 * asked, PIECE)
            if not piece:
                raise Fault("a member cut short")
            out.append(z.decompress(piece, MAX_RECORD + PIECE - size))
            size, at = size + len(out[-1]), at + len(piece)
            if size > MAX_RECORD or z.unconsumed_tail:
                raise Fault("a member over the longest size")
    except zlib.error as e:
        raise Fault(f"a member that does not inflate: {e}") from None
    return b"".join(out), at - len(z.unused_data)


def unit(get: Get, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member, or the plain record, at `at`, and where the next begins."""
    if get(at, 2) != b"\x1f\x8b":
        one, end = parsed(get, at)
        return [one], end
    data, end = inflated(get, at)
    inner, records, k = (lambda i, n: data[i : i + n]), [], 0
    while k < len(data) or not records:
        one, k = parsed(inner, k)
        records.append(one)
    return records, end


#: A version line counts wherever it stands: the byte before it may be the one that is damaged.
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def following(get: Get, at: int, end: int) -> int:
    """The first place from `at` on, before `end`, where a valid member or record begins; else `end`."""
    while at < end:
        piece = get(at, PIECE)
        for m in _CANDIDATE.finditer(piece):
            spot = at + m.start()
            if spot >= end:
                return end
            try:
                unit(get, spot)
                return spot
            except Fault:
                pass
        if len(piece) < PIECE:
            return end
        at += PIECE - 16  # a version line may lie across the pieces' edge
    return end


def salvaged(get: Get, start: int, end: int) -> Iterator[tuple[int, int, list[Record], str | None]]:
    """(start, end, records, fault) of what begins in start:end; a gap has a fault and no records."""
    at = start
    while at < end:
        try:
            records, upto = unit(get, at)
            yield at, upto, records, None
        except Fault as fault:
            upto = following(get, at + 1, end)
            yield at, upto, [], str(fault)
        at = upto


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int | None


class Reader(DataSourceReader):
    """Records, and the gaps between them, of the archives in a folder."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[Part]:
        store, path = _store(self.path)
        known = _manifest(store, path)
        if known is None:
            names = [f.base_name for f in store.get_file_info(pa.fs.FileSelector(path)) if f.is_file and re.search(r"\.warc(\.gz)?$", f.base_name)]
            return [Part(n, 0, None) for n in sorted(names)]
        return [Part(f["name"], a, b) for f in known for a, b in zip([0, *f["marks"]], [*f["marks"], f["bytes"]])]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, path = _store(self.path)
        rows: list[dict] = []
        held = 0
        for row in self._rows(store, f"{path}/{partition.name}", partition):
            rows.append({"archive": partition.name, **row})
            held += len(row.get("payload") or b"")
            if len(rows) == 1000 or held > 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    @staticmethod
    def _rows(store: pa.fs.FileSystem, path: str, part: Part) -> Iterator[dict]:
        try:
            file = store.open_input_file(path)
        except FileNotFoundError:
            yield {"start": part.start, "length": (part.end or 0) - part.start, "fault": "the archive is missing"}
            return
        with file:
            size = file.size()
            end = size if part.end is None else min(part.end, size)
            cache = [0, b""]

            def get(at: int, n: int) -> bytes:
                low, data = cache
                if not low <= at <= low + len(data) or at + n > low + len(data) < size:
                    cache[:] = low, data = at, file.read_at(min(max(n, 1 << 20), size - at), at) if at < size else b""
                return data[at - low : at - low + n]

            for start, upto, records, fault in salvaged(get, part.start, end):
                if fault:
                    yield {"start": start, "length": upto - start, "fault": fault}
                for r in records:
                    h = r.headers
                    yield {
                        "start": start, "length": upto - start, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
                        "date": h.get("warc-date"), "refers_to": h.get("warc-refers-to"), "payload_digest": r.digest, "payload_bytes": r.size, "payload": r.payload, "headers": list(h.items()),
                    }
            if part.end is not None and part.end > max(size, part.start):
                low = max(size, part.start)
                yield {"start": low, "length": part.end - low, "fault": "the archive is cut short"}


class WarcSource(DataSource):
    """Format `warc`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


# Tables


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """(key, url, payload, refers_to): of equal payloads of `least` bytes or more all but those of the smallest id refer to it.

    Rows that share the smallest id are all responses; a row without id comes after all
    others, and rows without ids alone are responses.  Payloads are told apart by their
    sha256.  Smallest ids are combined before the shuffle; where many digests occur more
    than once they are joined in SALTS parts each, so that copies of one page are spread.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("long", F.octet_length("payload") >= least)
    rows = rows.withColumn("digest", F.when(F.col("long"), F.unhex(F.sha2("payload", 256)))).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    salted = rows.filter("long").groupBy("digest", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = saved(salted.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("digest", "first"), "digests")
    if first.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        joined = rows.join(salted.join(first, "digest").select("digest", "salt", "first"), ["digest", "salt"], "left")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return joined.select(F.col("id").cast("string").alias("key"), "url", "payload", F.when(later, F.col("first").cast("string")).alias("refers_to"))


def write(rows: DataFrame, path: str, compression: str = "gzip", mode: str = "append") -> None:
    """What `with_revisits` gives, as archives in a folder that all of the cluster sees."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").option("compression", compression).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, and every gap, where `fault` says why; see SCHEMA."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def keys(records: DataFrame, kind: str = "bigint") -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to) of the records, ids as they were before writing."""

    @F.arrow_udf("string")
    def key(ids: pa.Array) -> pa.Array:
        return pa.array([key_of(x) for x in ids.to_pylist()], pa.string())

    return records.filter("fault IS NULL").select(key("record_id").cast(kind).alias("key"), "payload_bytes", "payload_digest", "record_type", key("refers_to").cast(kind).alias("refers_to"))


def quarantined(records: DataFrame) -> DataFrame:
    """(archive, start, length, fault): the byte gaps, as a log."""
    return records.filter("fault IS NOT NULL").select("archive", "start", "length", "fault")
