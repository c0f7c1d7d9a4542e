"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, fill_middle, hard_negatives, html_wrappers, jaccard_join, knn_quality, line_dedup, oracles, paragraph_dedup, pii, quality_rules, warc
from lodestar.llm.storage import folder, removed, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_near_line_dedup": oracles.LINE_DEDUP,
    "op4_repetition_rules": oracles.REPETITION,
    "op10_benchmark_windows": oracles.DECONTAMINATION,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_warc_salvage": oracles.WARC,
    "op13_dual_tree_negatives": oracles.HARD_NEGATIVES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


@query
def op10_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_near_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed(table(spark, sf_dir, "documents"))


@query
def op5_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


@query
def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded"))


@query
def op8_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn_quality.score(docs, knn_quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


@query
def op6_shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query
def op1_paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.spans(table(spark, sf_dir, "documents"))


@query
def op2_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_wrappers.extract(pages, saved(html_wrappers.wrappers(pages), "wrappers"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(fill_middle.restored("text", "form")).alias("restored_sha256"))


@query
def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = folder(spark, "archives")
    try:
        warc.write(warc.with_revisits(table(spark, sf_dir, "pages")), archives)
        return saved(warc.keys(warc.read(spark, archives)).withColumnRenamed("key", "page_id"), "warc")
    finally:
        removed(spark, archives)


@query
def op13_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    relabelled = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(relabelled, F.col("vec_id") % 100 == 0)
