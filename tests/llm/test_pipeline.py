"""The pipeline's stages: each acts on what the one before kept."""

import corpus_pipeline
from conftest import SF

from lodestar.llm import bpe
from lodestar.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(kept)
        if name == "quality_rules":
            want = {r["doc_id"] for r in QUERIES["op4_repetition_rules"](spark, SF).filter("kept").collect()}
            assert set(now) == want
        if name == "line_dedup":
            gone = {(r["doc_id"], r["line"]) for r in corpus_pipeline.line_dedup.removed(spark.read.parquet(f"{tmp_path}/quality_rules")).collect()}
            for d, text in kept.items():
                left = [x for i, x in enumerate(text.split("\n")) if (d, i) not in gone]
                assert now.get(d, "") == "\n".join(left) or (d not in now and not "".join(left).strip())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "near_duplicates":
            classes = {r["doc_id"]: r["component_id"] for r in corpus_pipeline.jaccard_join.classes(spark.read.parquet(f"{tmp_path}/line_dedup"), 5, 80).collect()}
            assert set(now) == set(classes.values())
        kept = now
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    tok = bpe.library()
    assert set(out) == set(kept)
    for d, text in kept.items():
        ids = tok.encode(text, add_special_tokens=False).ids
        assert list(out[d]["ids"]) == ids and out[d]["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(out)


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, an empty table."""
    prose = lambda k, n=70: " ".join(f"w{k}x{i}" for i in range(n))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [
        (None, prose(1), None, "s", None),
        (None, prose(2), "en", None, 9),
        (None, None, None, None, None),
        (5, "", "en", "s", 0),
        (5, prose(3), "en", "s", 1),
        (5, prose(4), "en", "s", 2),
        (5, prose(4), "en", "s", 2),
        (6, prose(3), "en", "s", 3),
        (7, f"{prose(5, 20)} {bench}", "en", "s", 4),
        (7, prose(6), "en", "s", 5),
        (8, prose(7, 30_000), "en", "s", 6),
        (9, "   \n\n ", "en", "s", 7),
    ]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    more = ("_m", "_own", "_key", "_stays", "_gone", "_kept", "_doc", "_text", "hits")
    docs = spark.createDataFrame(rows, kinds)
    for c in more:
        docs = docs.selectExpr("*", f"'x' AS {c}")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, SF).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == docs.columns
    texts = sorted(r["text"] for r in left.collect())
    assert texts == sorted(prose(k) for k in (1, 2, 3, 4, 6)) + [prose(7, 30_000)]
    out = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert out.count() == 6
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
