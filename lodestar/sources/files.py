"""Documents of several formats as rows of sections, read through Spark's binary files.

Formats are told by their first bytes and, for zip containers, by what they hold.  Only
the standard library reads them; the compound-file format of older word processors and
page layout of PDFs need packages that are not here, and give no sections but a reason.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that are taken, and first bytes by format.
EXTENSIONS = {".pdf": "pdf", ".hwp": "hwp", ".hwpx": "hwpx", ".docx": "docx", ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".txt": "txt", ".md": "md", ".html": "url"}
MAGIC = [("255044462D", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole2"), ("89504E47", "image"), ("FFD8FF", "image")]
ZIP_TYPES = ("docx", "pptx", "hwpx")
MAX_BYTES = 50 * 1024 * 1024


def doc_type(path: Column) -> Column:
    """The type by extension; null where it is not taken."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def magic(content: Column) -> Column:
    """What the first bytes say: pdf, zip, ole2, image, else text."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), "")
    for prefix, name in MAGIC:
        out = out.when(F.startswith(head, F.lit(prefix)), name)
    return out.otherwise("text")


def is_consistent(kind: Column, found: Column) -> Column:
    """Whether the first bytes fit the extension."""
    return F.when(kind.isin(*ZIP_TYPES), found == "zip").when(kind == "hwp", found.isin("ole2", "text")).when(kind.isin("pdf", "image"), found == kind).otherwise(found == "text")


def is_safe_url(url: Column) -> Column:
    """http or https with a host that is not local, private or link-local; names are not resolved."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|.*\.local|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|\[(::1?|f[cd].*|fe80.*)\])")
    return (host != "") & ~private


def _texts(node: ElementTree.Element, name: str) -> str:
    return "".join(e.text or "" for e in node.iter() if e.tag.rpartition("}")[2] == name)


def docx(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """(text, heading, page) of paragraphs and table rows in order; cells are parted by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))[0]
    title = None
    for block in body:
        kind = block.tag.rpartition("}")[2]
        if kind == "p" and (text := _texts(block, "t").strip()):
            style = next((v for e in block.iter() if e.tag.endswith("}pStyle") for k, v in e.attrib.items() if k.endswith("}val")), "")
            if style.lower().startswith(("heading", "title")):
                title = text
            yield text, title, 1
        elif kind == "tbl":
            for row in (r for r in block.iter() if r.tag.endswith("}tr")):
                cells = [_texts(c, "t").strip() for c in row if c.tag.endswith("}tc")]
                if any(cells):
                    yield " | ".join(cells), title, 1


def pptx(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """(text, title, slide) of every paragraph of every slide."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        title = None
        for p in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.endswith("}p")):
            if text := _texts(p, "t").strip():
                title = title or text
                yield text, title, number


def hwpx(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """(text, heading, section) of every paragraph of every section."""
    z = zipfile.ZipFile(io.BytesIO(data))
    parts = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
    for number, name in parts:
        title = None
        for p in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.endswith("}p")):
            if text := _texts(p, "t").strip():
                if "heading" in "".join(p.attrib.values()).lower():
                    title = text
                yield text, title, number + 1


def plain(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """Paragraphs parted by blank lines, else lines; a byte order mark is left out."""
    text = data.decode("utf-8-sig", "replace")
    for part in re.split(r"\n\s*\n", text) if re.search(r"\n\s*\n", text) else text.split("\n"):
        if part.strip():
            yield part.strip(), None, 1


def html(data: bytes) -> Iterator[tuple[str, str | None, int]]:
    """Text blocks without scripts, styles, navigation, header, footer and markup."""
    from html import unescape

    text = re.sub(r"(?is)<(script|style|nav|header|footer|aside|form)\b.*?</\1\s*>|<!--.*?-->", " ", data.decode("utf-8", "replace"))
    title = re.search(r"(?is)<h1[^>]*>(.*?)</h1>", text)
    heading = unescape(re.sub(r"<[^>]*>", "", title[1])).strip() if title else None
    text = re.sub(r"(?is)<(head)\b.*?</\1\s*>", " ", text)
    for part in re.split(r"(?i)</?(?:p|div|h[1-6]|li|tr|br|section|article)\b[^>]*>", text):
        if block := re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", part))).strip():
            yield block, heading, 1


READERS = {"docx": docx, "pptx": pptx, "hwpx": hwpx, "txt": plain, "md": plain, "url": html}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_type, size, sha256, reason, content) of every file below a path; `reason` says why one is left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = doc_type(F.col("path"))
    reason = F.when(kind.isNull(), "extension").when(F.col("length") > MAX_BYTES, "size").when(~is_consistent(kind, magic(F.col("content"))), "content").when(~kind.isin(*READERS), "unsupported")
    return rows.select("path", kind.alias("doc_type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), reason.alias("reason"), "content")


def sections(found: DataFrame) -> DataFrame:
    """(path, section_idx, page, title, text, reason): the sections of every file that can be
    read, and one row with the reason for every other; a file that cannot be parsed is `broken`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("section_idx", pa.int32()), ("page", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("reason", pa.string())]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["reason"]:
                    out.append((r["path"], None, None, None, None, r["reason"]))
                    continue
                try:
                    out += [(r["path"], i, page, title, text, None) for i, (text, title, page) in enumerate(READERS[r["doc_type"]](r["content"]))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError):
                    out.append((r["path"], None, None, None, None, "broken"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    return found.select("path", "doc_type", "reason", "content").mapInArrow(read, "path string, section_idx int, page int, title string, text string, reason string")
