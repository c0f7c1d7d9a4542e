"""Operators that spread their work against plain counting, with small ranges and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import queries as Q
from lodestar.functions import text as T
from lodestar.operators import filters, pages, percentiles, retrieval, similarity, windows


@pytest.mark.parametrize(("bins", "enough", "state"), [(4096, 100_000, 10_000), (2, 1, 10_000), (7, 3, 10_000), (4096, 100_000, 2), (3, 5, 1)])
def test_percentiles_by_narrowing(spark, monkeypatch, bins, enough, state):
    monkeypatch.setattr(percentiles, "BINS", bins)
    monkeypatch.setattr(percentiles, "ENOUGH", enough)
    monkeypatch.setattr(percentiles, "MAX_STATE", state)
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random() * 1000, 5.0, -3.0, 1e12, -1e300, 0.0, 5e-324, None])) for g in ["a", "b", None] for _ in range(rng.randint(1, 90))] + [("one", 7.0), ("none", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["low"], r["mid"], r["high"]) for r in percentiles.nearest(d, ["g"], "x", low=0.0, mid=0.5, high=0.95).collect()}
    between = {r["g"]: r["p"] for r in percentiles.interpolated(d, ["g"], "x", p=0.4).collect()}
    for g in {g for g, x in rows if x is not None}:
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(xs), xs[0], xs[int(0.5 * (len(xs) - 1))], xs[int(0.95 * (len(xs) - 1))])
        assert between[g] == pytest.approx(np.percentile(xs, 40))
    assert "none" not in got
    whole = sorted(x for _, x in rows if x is not None)
    assert percentiles.rounded(d, [], "x", p=0.3).first()["p"] == whole[round(0.3 * (len(whole) - 1))]
    ints = sorted(rng.randint(-5, 1 << 62) for _ in range(99))
    assert percentiles.nearest(spark.createDataFrame([(x,) for x in ints], "x bigint"), [], "x", p=0.25, q=1.0).first().asDict() == {"n": 99, "p": ints[24], "q": ints[98]}


def test_keys_are_in_order(spark):
    """The key is the bits of a double, mirrored below zero."""
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 1 << 64, 4000, dtype=np.uint64).view(np.float64)
    edges = [s * f * 2.0**e for e in range(-1074, 1024, 7) for f in (1.0, 1 + 2**-52, 2 - 2**-52) for s in (1, -1)]
    xs = [float(x) for x in [*xs[~np.isnan(xs)], *edges, 0.0, -0.0, float("inf"), float("-inf"), 1.7976931348623157e308, 2.2250738585072014e-308, 5e-324]]
    kind = spark.createDataFrame([], "x double").schema["x"].dataType
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", percentiles.order_key(F.col("x"), kind).alias("k")).collect()
    for r in got:
        bits = int(np.float64(abs(r["x"])).view(np.int64))
        assert r["k"] == (-bits if r["x"] < 0 else bits)


@pytest.mark.parametrize("far", [1e12, 1e300])
def test_an_outlier_leaves_no_full_range(spark, far):
    """However far one value is, the rows that are put in order are few, and a range is never the whole group."""
    d = spark.range(20_000).select((1_700_000_000 + F.rand(3) * 86_400).alias("x")).union(spark.createDataFrame([(far,), (-far,)], "x double"))
    base = d.select("x", F.lit("").alias("_"), percentiles.order_key(F.col("x"), d.schema["x"].dataType).alias("_k"))
    counts = base.groupBy("_", F.shiftright("_k", 49).alias("_bin")).agg(F.count("*").alias("_in"), F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    state = percentiles._held(counts, ["_"], {"p": lambda n: F.floor(0.5 * (n - 1))})
    once = percentiles._narrowed(base, state, ["_"], 1).first()
    assert once["_in"] < 20_000 / 100


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_numbers_without_one_sort(spark, monkeypatch, ranges):
    monkeypatch.setattr(windows, "RANGES", ranges)
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 300)
    d = spark.createDataFrame([(i, i % 3) for i in ids], "id bigint, first int").repartition(5)
    got = {r["id"]: (r["n"], r["_total"]) for r in windows.numbered(d, "id", "n").collect()}
    assert got == {x: (k, 300) for k, x in enumerate(sorted(ids))}
    got = {r["id"]: r["n"] for r in windows.numbered(d, "id", "n", "first").collect()}
    assert got == {x: k for k, x in enumerate(sorted(ids, key=lambda x: (x % 3, x)))}


def test_strings_with_a_common_beginning_are_parted(spark, monkeypatch):
    """Titles that differ only behind a long common beginning fall into many ranges of like size."""
    monkeypatch.setattr(windows, "RANGES", 16)
    d = spark.range(2000).select(F.concat(F.lit("the same beginning of every title "), F.sha2(F.col("id").cast("string"), 256)).alias("title"))
    sizes = [r["n"] for r in windows._ranged(d, "title").groupBy("_b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 200
    got = [r["title"] for r in windows.numbered(d, "title", "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 2000
    assert windows.numbered(d.limit(0), "title", "n").count() == 0


def test_quotas_add_up(spark):
    rng = random.Random(4)
    for size in (7, 20, 50):
        counts = {f"s{i}": rng.randint(1, 60) for i in range(9)}
        n = sum(counts.values())
        want = {k: max(1, round(size * c / n)) for k, c in counts.items()}
        over = sum(want.values()) - size
        for k in sorted(counts, key=lambda k: (-counts[k], k)):
            if over > 0 and want[k] > 1:
                want[k], over = want[k] - 1, over - 1
            elif over < 0 and want[k] < counts[k]:
                want[k], over = want[k] + 1, over + 1
        got = pages.quotas(spark.createDataFrame(list(counts.items()), "s string, n bigint"), "s", size)
        assert {r["s"]: r["quota"] for r in got.collect()} == want
    rows = spark.range(5).withColumn("s", F.lit("x"))
    assert pages.stratified(rows, "s", F.col("id"), 5, "id", 10).count() == 5


@pytest.mark.parametrize(("bins", "strata"), [(65_536, 100_000), (7, 100_000), (7, 1), (1, 100_000)])
def test_samples_without_a_sort(spark, monkeypatch, bins, strata):
    """The quota's smallest draws of every stratum, whatever their spread; few rows are put in order."""
    monkeypatch.setattr(pages, "BINS", bins)
    monkeypatch.setattr(pages, "MAX_STRATA", strata)
    rng = random.Random(bins)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b"]), rng.choice([rng.randint(0, 999), 5, 999])) for i in range(600)] + [(1000, "lone", 999)]
    d = spark.createDataFrame(rows, "id bigint, s string, x int").repartition(3)
    got = {(r["s"], r["id"]) for r in pages.stratified(d, "s", F.col("x"), 1000, "id", 60).collect()}
    counts = d.groupBy("s").agg(F.count("*").alias("n"))
    quota = {r["s"]: r["quota"] for r in pages.quotas(counts, "s", 60).collect()}
    assert sum(quota.values()) == 60
    assert got == {(s, i) for s, q in quota.items() for _, i in sorted((x, i) for i, t, x in rows if t == s)[:q]}


def test_tiers_of_near_duplicates(spark):
    v = lambda *x: list(map(float, x))
    rows = [(1, "u", "annual report.pdf", v(1, 0, 0)), (2, "u", "scan.pdf", v(1, 0.05, 0)), (3, "u", "plan v1.docx", v(0, 1, 0)), (4, "u", "plan v2.docx", v(0, 1, 0.45)), (5, "u", "other name", v(0, 0.3, -1)), (6, "w", "annual report.pdf", v(1, 0, 0))]
    d = spark.createDataFrame(rows, "doc_id bigint, user_id string, title string, vec array<double>")
    near = similarity.nearest(d, "user_id")
    names = d.select("doc_id", "title")
    both = near.join(names.withColumnsRenamed({"doc_id": "id", "title": "a"}), "id").join(names.withColumnsRenamed({"doc_id": "of", "title": "b"}), "of")
    got = {r["id"]: (r["of"], r["tier"]) for r in both.select("id", "of", retrieval.dedup_tier(F.col("sim"), T.name_ratio(F.col("a"), F.col("b"))).alias("tier")).collect()}
    assert got[1] == (2, 2) and got[2] == (1, 2) and got[3] == (4, 3) and got[4] == (3, 3) and got[5][1] is None and 6 not in got


def test_filter_plans(spark):
    asked = {"#투자": ("tag", None), "어제 받은 문서": ("date+title", "받은 문서"), "2025년 3월 회의록": ("date+title", "회의록"), "프로젝트 X 기획서": ("title", "프로젝트 X 기획서"), "왜 이 펀드가 손실났나": None, "#투자 수익률 어떻게 계산": None, "결론": None, "": None}
    d = spark.createDataFrame([(q,) for q in asked], "q string").select("q", Q.filter_plan(F.col("q"), "2024-01-31").alias("p"))
    got = {r["q"]: (r["p"]["kind"], r["p"]["title"]) if r["p"] else None for r in d.collect()}
    assert got == asked
    docs = spark.createDataFrame([(i, f"Plan {i}", ["a"] if i % 2 else ["a", "b"]) for i in range(6)], "doc_id bigint, title string, tags array<string>").withColumn("created_at", F.timestamp_seconds(F.col("doc_id") * 86400))
    plans = spark.createDataFrame([(1, None, None, ["b"], None), (2, "1970-01-02", "1970-01-04", [], None), (3, None, None, [], "plan 5"), (4, "1970-01-01", "1970-01-05", ["a"], "n 3")], "ask_id int, start string, end string, tags array<string>, title string")
    plans = plans.withColumn("start", F.col("start").cast("date")).withColumn("end", F.col("end").cast("date"))
    found = {(r["ask_id"], r["doc_id"], r["place"]) for r in filters.by_plan(docs, plans, 2).collect()}
    assert found == {(1, 4, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2), (3, 5, 1), (4, 3, 1)}


def test_packing_and_merging_lose_no_words(spark):
    """Sentence packing and section merging against their rules: sizes, order and words."""
    rng = random.Random(6)
    for _ in range(60):
        text = " ".join("".join(rng.choice("가나다라 마바") for _ in range(rng.randint(1, 90))).strip() + rng.choice([".", "!", "?", "", " 2024. 1. 3. 끝"]) for _ in range(rng.randint(1, 60)))
        pieces = T.pack(text, overlap=0)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        assert all(len(p) <= 1000 for p in pieces)
        led = T.pack(text)
        assert len(led) == len(pieces) and all(x.endswith(p) and len(x) <= 1000 for x, p in zip(led, pieces))


def test_diversity_by_trying_all(spark):
    """MMR picks, at every place, the row of the greatest value among those left."""
    rng = np.random.default_rng(7)
    vecs = rng.standard_normal((12, 4))
    rel = rng.random(12).round(3)
    d = spark.createDataFrame([(1, i, float(rel[i]), vecs[i].tolist()) for i in range(12)], "query_id int, id int, relevance double, vec array<double>")
    got = [r["id"] for r in retrieval.mmr(d, 6).orderBy("place").collect()]
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    picked = []
    for _ in range(6):
        value = lambda i: 0.7 * rel[i] - 0.3 * max([0.0, *(float(unit[i] @ unit[j]) for j in picked)])  # noqa: B023, E731
        picked.append(max((i for i in range(12) if i not in picked), key=lambda i: (value(i), -i)))
    assert got == picked


def vectors_in_groups(rng, n, dims=8, groups=12):
    centers = rng.standard_normal((groups, dims))
    return [(centers[rng.integers(groups)] + 0.25 * rng.standard_normal(dims)).tolist() for _ in range(n)]


@pytest.mark.parametrize(("cell", "visitors", "busy", "kind"), [(2000, 50_000, 200_000, "bigint"), (20, 50_000, 200_000, "string"), (10, 7, 200_000, "bigint"), (10, 7, 0, "bigint")])
@pytest.mark.parametrize("at_least", [-1.0, 0.9])
def test_nearest_by_all_pairs(spark, monkeypatch, cell, visitors, busy, kind, at_least):
    """Cells, blocks, visits, copies and ties against every pair."""
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity, "VISITORS", visitors)
    monkeypatch.setattr(similarity, "MAX_BUSY", busy)
    rng = np.random.default_rng(cell)
    vecs = vectors_in_groups(rng, 260)
    rows = [(i, "big", v) for i, v in enumerate(vecs)]
    rows += [(1000 + i, "big", vecs[3]) for i in range(90)]  # a third are copies of one vector
    rows += [(2000 + i, "big", [2 * x for x in vecs[3]]) for i in range(3)]  # the same direction
    rows += [(3000 + i, "small", v) for i, v in enumerate(vecs[:7])] + [(3100, "one", vecs[0])]
    rows += [(4000, "big", [0.0] * 8), (4001, "big", None), (4002, None, vecs[0]), (None, "big", vecs[1]), (4003, "big", [1.0, 2.0]), (4004, "big", [2.0, 1.0])]
    name = (lambda i: None if i is None else f"{i:05d}") if kind == "string" else (lambda i: i)
    rows = [(name(i), t, v) for i, t, v in rows]
    d = spark.createDataFrame(rows, f"doc_id {kind}, t string, vec array<double>").repartition(3)
    got = {r["id"]: (r["of"], r["sim"]) for r in similarity.nearest(d, "t", at_least=at_least).collect()}
    want = {}
    usable = [(i, t, np.array(v) / np.linalg.norm(v)) for i, t, v in rows if None not in (i, t) and v and np.linalg.norm(v) > 0]
    for i, t, v in usable:
        found = [(-round(float(v @ w), 9), j) for j, u, w in usable if j != i and u == t and len(w) == len(v)]
        if found and -min(found)[0] >= at_least:
            want[i] = (min(found)[1], -min(found)[0])
    assert {i: of for i, (of, _) in got.items()} == {i: of for i, (of, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-9 for i in want)


def test_visits_are_few_and_enough():
    """Everything within a row's radius lies in a cell that it visits, and on rows in groups it visits few."""
    rng = np.random.default_rng(3)
    x = np.array(vectors_in_groups(rng, 3000, 16, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[::50]
    dot = x @ pivots.T
    home = dot.argmax(axis=1)
    away = np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
    reach = np.array([away[home == c].max(initial=0) for c in range(len(pivots))])
    radius = similarity._radius(np.full(len(x), -1.0), 0.85)
    row, cell = similarity.visits(x, home, radius, pivots, reach)
    seen = set(zip(row.tolist(), cell.tolist()))
    a, b = np.nonzero(x @ x.T >= 0.85)
    assert all((i, home[j]) in seen for i, j in zip(a.tolist(), b.tolist()))
    assert len(seen) < 0.35 * len(x) * len(pivots)


@pytest.mark.parametrize("bytes_", [32 << 20, 300])
def test_neighbours_of_anchors(spark, monkeypatch, bytes_):
    """Every pair of an anchor and a row of its group against all pairs, in one block of anchors and in many."""
    monkeypatch.setattr(retrieval, "QUERY_BYTES", bytes_)
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), v) for i, v in enumerate(vectors_in_groups(rng, 120))] + [(500, "hot", None), (501, "hot", [0.0] * 8)]
    rows = [(i, None if g is None else str(g), v) for i, g, v in rows]
    d = spark.createDataFrame(rows, "doc_id bigint, g string, vec array<double>").repartition(3)
    asked = d.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r["query_id"], r["id"]) for r in retrieval.above(d, asked, 0.7, "g").collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v and np.linalg.norm(v)}
    group = {i: g for i, g, _ in rows}
    assert got == {(a, b) for a in unit if a % 10 == 0 and group[a] for b in unit if a != b and group[a] == group[b] and round(float(unit[a] @ unit[b]), 9) >= 0.7}
    assert retrieval.above(d, asked.limit(0), 0.7, "g").count() == 0
