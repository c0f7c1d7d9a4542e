"""A corpus pipeline: each stage is written as Parquet and read again by the next.

Quality rules, line dedup, near duplicates, benchmark decontamination, BPE.  Every stage
works on whole texts of all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and
ids, and columns of any further names, which it keeps; of an empty table nothing is left.
Null and empty texts fail the quality rules.  Decisions are made by row: rows that share an
id, or have none, are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from lodestar.llm.storage import folder, removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; each row is judged by itself."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those left without a word go.

    Of equal lines the one of the smallest (id, hash of the text, line number) stays."""
    return line_dedup.clean(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more.

    The row of the smallest id stays, and of the smallest hash of its text where ids are equal."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages; each row is judged by itself."""
    return decontaminate.clean_text(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that decoding them gives; a null text has no ids."""
    return bpe.encode(docs, decoded="decoded").select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Components of links and BPE have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, through Parquet in the shared checkpoint folder.

    A stage's table is removed once the next one is written; that of the last but one stays,
    as the result is read from it."""
    base = folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            removed(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
