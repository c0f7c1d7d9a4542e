"""Fill-in-middle, WARC archives and hard negatives against brute force, and on awkward input."""

import gzip
import hashlib
import os
import random
import re

import numpy as np
import pytest
from conftest import SF
from oracle import answer, rows
from pyspark.sql import functions as F

from lodestar.llm import bpe, fill_middle, hard_negatives, html_wrappers, warc
from lodestar.llm.queries import ORACLES, QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
AWKWARD = [None, "", " ", "\n\n", "abc", "<P>", "a<S>b", "x<M", "<", "é", "北京 ab\U0001f600cd", "\x00a\x00", "ab " * 40_000, "x" * 100_000, "é" * 70_000, "same", "same"]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_warc_salvage", "op13_dual_tree_negatives"])
def test_queries_against_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), answer(ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Fill in the middle


def told(key, text, seed=1, rate=90, spm=20):
    """(n, form, prefix_chars, middle_chars, output), character by character."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), out


@pytest.mark.parametrize(("chunk", "slab"), [(1, 1), (3, 10), (7, 64), (1 << 14, 1 << 22)])
def test_cuts_of_every_rank(monkeypatch, chunk, slab):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "SLAB", slab)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["a", "Z", "é", "北", "\U0001f600", " ", "1", "[", "@", "`", "{", "\x80"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    data = [t.encode() for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    chunks = fill_middle.Chunks(np.frombuffer(b"".join(data), np.uint8), begin)
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        assert chunks.count()[i] == len(units)
        for rank in range(len(units) + 1):
            before = "".join(units[:rank])
            assert chunks.cut(i, rank) == (len(before.encode()), len(before))


def test_fill_in_middle(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice("ab Cé.<>PSM") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    ids = [None, 5, 5, *range(len(texts) - 3)]
    d = spark.createDataFrame([(i, t, 1, "f", "k") for i, t in zip(ids, texts)], "doc_id bigint, text string, n int, form string, _fim string").repartition(3)
    out = fill_middle.fill_in_middle(d, seed=7, rate=80, spm=50)
    assert out.columns == [*d.columns, "_n", "_form", "prefix_chars", "middle_chars"]
    out = out.withColumn("back", fill_middle.restored("text", "_form"))
    got = sorted(map(repr, ((r["doc_id"], r["_n"], r["_form"], r["prefix_chars"], r["middle_chars"], r["text"], r["back"]) for r in out.collect())))
    assert got == sorted(map(repr, ((i, *told(i, t, 7, 80, 50), t or "") for i, t in zip(ids, texts))))
    assert {r["_form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(d.limit(0)).count() == 0


# WARC


PAGES = [
    (1, "http://a.example/1", "x" * 200),
    (2, "http://a.example/2", "x" * 200),
    (3, None, "x" * 200),
    (None, "http://b.example/ ü\n", "x" * 200),
    (4, "u", "short"),
    (5, "u", "short"),
    (6, "u", None),
    (7, "u", ""),
    (8, "u", "é" * 50),
    (9, "u", "é" * 50),
    (10, "u", "é" * 49 + "x"),
    (11, "u", "é" * 49 + "x"),
    (12, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + "y" * 100),
    (13, "u", "z" * 300_000),
    (None, "u", "n" * 150),
    (None, "v", "n" * 150),
    (14, "same", "s" * 120),
    (14, "same", "s" * 120),
]


def expected(pages):
    first = {}
    for i, _, t in pages:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in pages:
        f = first.get(t) if len((t or "").encode()) >= 100 else None
        again = f is not None and (i is None or i > f)
        data = (t or "").encode()
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, t, "x", "y", "z") for i, u, t in PAGES], "page_id bigint, url string, html string, key string, digest string, first string").repartition(3)


@pytest.mark.parametrize(("compression", "broadcast"), [("gzip", 100_000), ("none", 0)])
def test_archives_round_trip(spark, pages, tmp_path, monkeypatch, compression, broadcast):
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    warc.write(warc.with_revisits(pages), f"file://{tmp_path}/w", compression)
    records = warc.read(spark, f"file://{tmp_path}/w")
    got = sorted(repr((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in warc.keys(records).collect())
    assert got == expected(PAGES)
    assert warc.quarantined(records).count() == 0
    texts = {warc.key_of(r["record_id"]): r["payload"].decode() for r in records.filter("record_type = 'response'").collect()}
    assert texts["13"] == "z" * 300_000 and texts["6"] == "" and texts["12"] == PAGES[12][2]
    assert next(r["target_uri"] for r in records.filter("record_id = '<urn:lodestar:none>' AND record_type = 'revisit'").collect()) == "http://b.example/%20ü%0A"


def test_no_rows(spark, pages, tmp_path):
    warc.write(warc.with_revisits(pages.limit(0)), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


def test_a_task_run_again_counts_once(spark, pages, tmp_path):
    warc.write(warc.with_revisits(pages), f"file://{tmp_path}/w")
    stray = next(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    (tmp_path / "w" / ("again-" + stray)).write_bytes((tmp_path / "w" / stray).read_bytes())
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(PAGES)
    warc.write(warc.with_revisits(pages.filter("page_id = 4")), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(PAGES) + 1


def archive(compressed, n=30, seed=0):
    """Records of an archive, as bytes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice("ab \r\n\x1fWARC/1.1é") for _ in range(rng.randint(0, 400)))
        data = warc.record(str(i), f"http://h/{i}", text.encode(), None)
        out.append(warc.member(data) if compressed else data)
    return out


def read_all(data, start=0):
    return list(warc.salvaged(lambda at, n: data[at : at + n], start, len(data)))


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_after_every_kind_of_damage(compressed):
    """Every record that no damaged byte touches comes back, and all bytes are accounted for.

    A plain record whose damage is in a header that no digest covers may pass as valid."""
    parts = archive(compressed)
    edges = np.cumsum([0, *map(len, parts)])
    rng = random.Random(9)
    for _ in range(150):
        data, hurt = bytearray(b"".join(parts)), set()
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            n = rng.choice([1, 1, 5, 60, 700])
            data[at : at + n] = bytes(b ^ rng.randint(1, 255) for b in data[at : at + n])
            hurt |= set(range(np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, min(at + n, len(data)) - 1, "right")))
        found = read_all(bytes(data))
        assert [a for a, *_ in found[1:]] == [b for _, b, *_ in found[:-1]] and found[0][0] == 0 and found[-1][1] >= len(data)
        spans = {(int(edges[i]), int(edges[i + 1])) for i in range(30) if i not in hurt}
        assert spans <= {(a, b) for a, b, _, fault in found if not fault}
        assert all((a, b) not in spans for a, b, _, fault in found if fault)


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_of_cut_and_foreign_bytes(compressed):
    parts = archive(compressed)
    data = b"".join(parts)
    for cut in (1, len(parts[0]) // 2, len(data) - 1, len(data) - len(parts[-1]) - 3):
        kept = np.cumsum([len(p) for p in parts]) <= cut
        assert sum(len(r) for _, _, r, _ in read_all(data[:cut])) == kept.sum()
    noise = b"\x1f\x8b\x08junk\nWARC/1.1\r\nnot a header\r\n\r\n"
    found = read_all(noise + parts[0] + noise + parts[1] + noise)
    assert [bool(f) for *_, f in found] == [True, False, True, False, True]
    assert all(b - a == len(noise) for a, b, _, f in found if f)


def test_members_of_several_records_and_bad_fields():
    one, two = archive(False, 2)
    data = gzip.compress(one + two)
    assert [len(r) for _, _, r, _ in read_all(data)] == [2]
    for broken, why in [
        (one.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0"), "payload"),
        (one.replace(b"WARC-Block-Digest: sha256:", b"WARC-Block-Digest: sha256:0"), "block"),
        (re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", lambda m: b"Content-Length: 1%s\r\n\r\nHTTP" % m[1], one), "block"),
        (one.replace(b"WARC/1.1", b"WARC/9.1", 1), "version"),
        (one.replace(b"WARC-Type: response", b"WARC-Type response"), "colon"),
        (re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: x\r\n\r\nHTTP", one), "length"),
    ]:
        for data in (broken + two, gzip.compress(broken) + gzip.compress(two)):
            (a, b, none, fault), (_, _, got, fine) = read_all(data)
            assert why in fault and not none and len(got) == 1 and fine is None


def test_quarantine_over_splits(spark, tmp_path, monkeypatch):
    """Splits at marks, a damaged archive, one cut short and one gone: rows and gaps add up to the manifest's bytes."""
    monkeypatch.setattr(warc, "SPLIT", 2000)
    d = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).repartition(3)
    path = tmp_path / "w"
    writer = warc.Writer({"path": str(path)}, True)
    monkeypatch.setattr(warc.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    parts = [writer.write(iter(p.to_batches())) for p in [warc.with_revisits(d.filter(F.col("page_id") % 3 == k)).toArrow() for k in range(3)]]
    writer.commit(parts)
    monkeypatch.undo()
    names = [p.files[0]["name"] for p in parts]
    assert all(len(p.files[0]["marks"]) > 3 for p in parts)
    records = warc.read(spark, str(path))
    assert records.count() == 400 and records.select("payload").distinct().count() == 400
    whole = sum(p.files[0]["bytes"] for p in parts)
    a = bytearray((path / names[0]).read_bytes())
    a[5000:5010] = b"0123456789"
    (path / names[0]).write_bytes(a)
    (path / names[1]).write_bytes((path / names[1]).read_bytes()[:3000])
    os.remove(path / names[2])
    got = records.select("archive", "start", "length", "fault").distinct().collect()
    assert sum(r["length"] for r in got) == whole
    assert {r["fault"] for r in got if r["archive"] == names[2]} == {"the archive is missing"}
    assert any("cut short" in r["fault"] for r in got if r["fault"] and r["archive"] == names[1])
    assert sum(1 for r in got if r["fault"] and r["archive"] == names[0]) == 1
    (path / warc.MANIFEST).unlink()
    assert warc.read(spark, str(path)).filter("fault IS NULL").count() == sum(1 for r in got if not r["fault"])


# Hard negatives


def mined(vectors, k=5, low=80, high=100):
    """By all pairs, in Python's whole numbers."""
    usable = []
    for i, label, v in vectors:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for anchor, label, q in {(i, lb, tuple(v)) for i, lb, v in usable if i % 10 == 0}:
        scored = [(i, lb, sum(a * b for a, b in zip(q, v))) for i, lb, v in usable if i != anchor]
        best = sorted((s for s in scored if s[1] == label), key=lambda s: (-s[2], s[0]))[:k]
        for p, _, ps in best:
            near = sorted((s for s in scored if s[1] != label and low * ps <= 100 * s[2] <= high * ps), key=lambda s: (-s[2], s[0]))[:k]
            out += [(anchor, p, rank, i, ps, s) for rank, (i, _, s) in enumerate(near, 1)]
    return sorted(out)


def some_vectors(rng, n, dims=8, clusters=6, spread=0.15):
    centers = rng.standard_normal((clusters, dims))
    return [(i, int(rng.integers(0, 4)), (centers[rng.integers(clusters)] + spread * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("anchors", "leaf", "batch"), [(65_536, 64, 10_000), (7, 3, 20), (20, 8, 1)])
def test_hard_negatives_by_all_pairs(spark, monkeypatch, anchors, leaf, batch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives.Tree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(hard_negatives, "NEAR", 2 * leaf)
    monkeypatch.setattr(hard_negatives, "PAIRS", 50)
    rng = np.random.default_rng(leaf)
    vectors = some_vectors(rng, 220)
    vectors += [(300 + i, 1, vectors[0][2]) for i in range(40)] + [(400 + i, 2, vectors[0][2]) for i in range(40)]  # ties
    vectors += [(20, vectors[20][1], vectors[20][2]), (21, vectors[21][1], vectors[21][2])]  # repeated rows
    vectors += [(None, 1, [1.0] * 8), (500, None, [1.0] * 8), (510, 1, None), (520, 1, [1.0, None] * 4), (530, 1, [float("nan")] * 8), (540, 1, [float("inf")] * 8), (550, 1, [0.0] * 8), (560, 3, [-5.0] * 8), (570, 9, [1.0] * 8)]
    kinds = "vec_id bigint, label int, embedding array<float>, id string, vec string, _anchor string"
    d = spark.createDataFrame([(*v, "x", "y", "z") for v in vectors], kinds).repartition(4)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        out = hard_negatives.mine(d, F.col("vec_id") % 10 == 0)
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set(key, before)
    want = mined(vectors)
    assert got == want and len(want) > 200
    assert hard_negatives.mine(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(d.filter("vec_id % 10 <> 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components_and_unequal_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, i % 2, (rng.integers(-400_000, 400_000, rng.integers(1, 6))).astype(float).tolist()) for i in range(60)]
    d = spark.createDataFrame(vectors, "vec_id bigint, label string, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.mine(d, F.col("vec_id") % 10 == 0).collect())
    assert got == mined(vectors)


def test_intervals_hold_and_prune():
    """Every product lies within its nodes' bounds, and on rows in groups most pairs of leaves are never scored."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([c + 0.02 * rng.standard_normal((400, 16)) for c in rng.standard_normal((8, 16))]))
    a, b = hard_negatives.Tree(x[::4]), hard_negatives.Tree(x)
    bound = a.least(np.sort(x[::4] @ x.T, axis=1)[:, -10])

    def keep(u, v, least, most):
        for i, j, lo, hi in zip(u, v, least, most):
            s = x[::4][a.rows(i)] @ x[b.rows(j)].T
            assert lo <= s.min() and s.max() <= hi
        return most >= bound[u]

    scored = sum(len(a.rows(i)) * len(b.rows(j)) for u, v in hard_negatives.leaf_pairs(a, b, keep) for i, j in zip(u, v))
    assert 0 < scored < 0.35 * 800 * 3200


# Token counts


def test_token_counts_of_random_texts(spark):
    """Counts against the library on texts of letters that normalising and lower-casing change, whole corpus tables or none."""
    rng = random.Random(5)
    pool = list("abcIİıÅéß ,.'̧᳖̇́ͅΣςǅŉﬁK") + ["İ̧", "İ᳖", "<|endoftext|>", "北", "\U0001f600", "‍", "각", "\x00", "\x1b", "\x7f", "\x85"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 20))) for _ in range(4000)] + ["İ̧", "İ᳖", "x" * 50_000]
    tok = bpe.library()
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    assert [r["n_tokens"] for r in bpe.token_counts(got).orderBy("doc_id").collect()] == want
    table = bpe.frequent(got, size=20)
    assert 0 < len(table) <= 20
    cut = bpe.Cutter()
    for size in (150_000, 5):
        lengths = bpe._Lengths(table, bpe.MODEL)
        bpe_size, bpe.COUNTS = bpe.COUNTS, size
        try:
            assert [n for at in range(0, len(texts), 50) for n in lengths.counts([cut.pieces(t) for t in texts[at : at + 50]])] == want
        finally:
            bpe.COUNTS = bpe_size


# Main text


BODY = "<h1>Title here</h1><p>" + "A sentence of the article stands here. " * 8 + "</p><p>Its second part ends it.</p>"
TEXT = "Title here " + ("A sentence of the article stands here. " * 8).strip() + " Its second part ends it."
OUTER = {
    "sidebar": f'<div class="layout has-sidebar"><article>{BODY}</article><div class="sidebar">Other things to see</div></div>',
    "menu": f'<div id="page" class="menu-closed"><nav>a b c</nav><main>{BODY}</main></div>',
    "comments": f'<div class="post comments-closed">{BODY}</div><footer>the end</footer>',
    "form": f'<form id="aspnetForm"><div class="nav">x y</div><div id="content">{BODY}</div></form>',
}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 30])
@pytest.mark.parametrize("kind", sorted(OUTER))
def test_outer_words_do_not_empty_a_page(kind, n):
    """An everyday class or form around the page takes nothing away, however many pages a host has."""
    pages = [f"<html><body>{OUTER[kind]}</body></html>"] * n
    wrapper = html_wrappers.merged([html_wrappers.Page(p).folded().root for p in pages])
    assert {html_wrappers.Reader(wrapper).text(p) for p in pages} == {TEXT}


@pytest.mark.parametrize("n", [2, 7, 8, 30])
@pytest.mark.parametrize("around", ["article", "div"])
def test_an_article_that_repeats_stays(n, around):
    """Pages of one host with one article and a varying line: the article is kept at any count."""
    pages = [f"<html><body><p class='date'>Seen {i} of March at {i} hours</p><{around}>{BODY}</{around}></body></html>" for i in range(n)]
    wrapper = html_wrappers.merged([html_wrappers.Page(p).folded().root for p in pages])
    assert all(html_wrappers.Reader(wrapper).text(p).endswith(TEXT) for p in pages)


@pytest.mark.parametrize("n", [2, 9])
def test_parts_that_are_the_same_everywhere_go(n):
    """Without article elements the host's wrapper tells a standing text from what changes; a page alone cannot."""
    pages = [f"<html><body><div id='about'>{'About this house we say the same. ' * 4}</div><div id='text'><p>{f'Story number {i} goes its own way. ' * 9}</p></div></body></html>" for i in range(n)]
    roots = [html_wrappers.Page(p).folded().root for p in pages]
    alone = html_wrappers.Reader(html_wrappers.Page(pages[0]).folded().root).text(pages[0])
    shared = html_wrappers.Reader(html_wrappers.merged(roots))
    assert "About this house" in alone
    assert [shared.text(p) for p in pages] == [(f"Story number {i} goes its own way. " * 9).strip() for i in range(n)]


def test_small_parts_with_such_words_go():
    """Comments, related articles and forms that are a minor part stay out."""
    page = f"<html><body><article>{BODY}</article><div class='comments'><p>I say this</p></div><div class='related'><article>Teaser</article></div><form><p>Your mail</p></form></body></html>"
    wrapper = html_wrappers.Page(page).folded().root
    assert html_wrappers.Reader(wrapper).text(page) == TEXT
