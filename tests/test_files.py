"""File sources: formats, broken files, size and content checks."""

import io
import zipfile

from pyspark.sql import functions as F

from lodestar.sources import files

NS = 'xmlns:w="w" xmlns:a="a" xmlns:hp="hp"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_sections(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped(**{"word__document.xml": f'<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}))
    (tmp_path / "b.pptx").write_bytes(zipped(**{"ppt__slides__slide1.xml": f"<x {NS}><a:p><a:r><a:t>Slide</a:t></a:r></a:p></x>"}))
    (tmp_path / "c.hwpx").write_bytes(zipped(**{"Contents__section0.xml": f"<x {NS}><hp:p><hp:t>절</hp:t></hp:p></x>"}))
    (tmp_path / "d.txt").write_bytes("﻿one\n\ntwo".encode())
    (tmp_path / "e.html").write_text("<html><head><title>x</title></head><body><nav>menu</nav><h1>T &amp; t</h1><p>p1</p></body></html>")
    (tmp_path / "f.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "g.exe").write_bytes(b"MZ")
    (tmp_path / "h.pdf").write_bytes(b"not a pdf")
    found = files.files(spark, str(tmp_path))
    rows = [(r["path"][-6:], r["text"], r["title"], r["reason"]) for r in files.sections(found).orderBy("path", "section_idx").collect()]
    assert rows == [
        ("a.docx", "Top", "Top", None), ("a.docx", "Body", "Top", None), ("a.docx", "1 | 2", "Top", None),
        ("b.pptx", "Slide", "Slide", None), ("c.hwpx", "절", None, None),
        ("/d.txt", "one", None, None), ("/d.txt", "two", None, None),
        ("e.html", "T & t", "T & t", None), ("e.html", "p1", "T & t", None),
        ("f.docx", None, None, "broken"), ("/g.exe", None, None, "extension"), ("/h.pdf", None, None, "content"),
    ]


def test_urls(spark):
    urls = ["https://example.com/a", "http://127.0.0.1/x", "ftp://example.com", "http://192.168.1.1", "http://user@10.0.0.1/", "http://[::1]/", "https://8.8.8.8"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(files.is_safe_url(F.col("u")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False, True]


def test_evaluation_tables_and_reports(spark, tmp_path):
    from lodestar.sources import evaluation

    (tmp_path / "g.csv").write_text('﻿id,query,relevant_chunks\n1, "a, ""b""",3\n ,none,4\n2,c,a:3|b:4\n3,d,\n', encoding="utf-8")
    (tmp_path / "g.tsv").write_text("id\tquery\trelevant_chunks\n1\tx\t1,2\n", encoding="utf-8")
    (tmp_path / "g.json").write_text('[{"id": 7, "query": " q ", "relevant_chunks": "5"}, {"id": null, "query": "z", "relevant_chunks": ""}]', encoding="utf-8")
    rows = {}
    for kind in ("csv", "tsv", "json"):
        found = evaluation.table(spark, str(tmp_path / f"g.{kind}")).withColumn("labels", evaluation.chunk_labels("relevant_chunks"))
        rows |= {(kind, r["id"]): (r["query"], [(x["alias"], x["idx"]) for x in r["labels"]]) for r in found.collect()}
    assert rows[("csv", "2")] == ("c", [("a", 3), ("b", 4)]) and rows[("csv", "3")] == ("d", [])
    assert rows[("tsv", "1")] == ("x", [(None, 1), (None, 2)]) and rows[("json", "7")] == ("q", [(None, 5)])
    assert set(rows) == {("csv", "1"), ("csv", "2"), ("csv", "3"), ("tsv", "1"), ("json", "7")}
    report = spark.createDataFrame([("b|c", 2.5, None), ("a", 1.0, 3)], "name string, ms double, n int")
    assert [r["line"] for r in evaluation.markdown(report, "name").collect()] == ["| name | ms | n |", "|---|---|---|", "| a | 1.0 | 3 |", "| b\\|c | 2.5 | - |"]
    evaluation.write_json(report, str(tmp_path / "out"))
    evaluation.write_markdown(report, "name", str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and spark.read.text(str(tmp_path / "md")).count() == 4
