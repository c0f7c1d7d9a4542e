"""Evaluation tables from CSV, TSV and JSON files, and report sinks as JSON lines and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a .csv, .tsv or .json file as text columns, trimmed; a byte order mark belongs to no name.
    Rows without an `id` are left out."""
    if path.endswith(".json"):
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    else:
        rows = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in rows.columns]).filter("id <> ''")


def chunk_labels(column: str) -> Column:
    """array<struct<alias, idx>> of a list such as `3, 4` or `a:3|b:4`; parts that hold no number are left out."""
    parts = F.regexp_extract_all(column, F.lit(r"(?:([^,;|:\s]+)\s*:\s*)?(\d+)\s*(?:[,;|]|$)"), F.lit(0))
    each = F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, r"^([^,;|:\s]+)\s*:", 1), F.lit("")).alias("alias"), F.regexp_extract(p, r"(\d+)\s*[,;|]?$", 1).cast("int").alias("idx")))
    return F.filter(each, lambda x: x.idx.isNotNull())


def write_json(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one folder."""
    report.write.mode("overwrite").json(path)


def markdown(report: DataFrame, order: str) -> DataFrame:
    """(line): a report's rows as a Markdown table in order of a column; nulls are dashes, bars are escaped."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = report.sparkSession.createDataFrame([(0, "| " + " | ".join(report.columns) + " |"), (1, "|" + "---|" * len(report.columns))], "part int, line string")
    body = report.select(F.lit(2).alias("part"), row([cell(c) for c in report.columns]).alias("line"), F.col(order).alias("_o"))
    lines = head.withColumn("_o", F.lit(None).cast(report.schema[order].dataType)).unionByName(body)
    return lines.orderBy("part", "_o", "line").select("line")


def write_markdown(report: DataFrame, order: str, path: str) -> None:
    """A report, which is small, as one Markdown file in a folder."""
    markdown(report, order).coalesce(1).write.mode("overwrite").text(path)
