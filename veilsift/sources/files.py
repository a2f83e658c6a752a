"""Local and stored files: pages, targets, benchmark cases, images and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path and html of files; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def fetched(content: Column) -> Column:
    """A response's bytes as text: UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """path and html of stored responses."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", fetched(F.col("content")).alias("html"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a JSON list: company, ats, board. Entries without system or token don't count."""
    rows = spark.read.schema("company string, ats string, token string").option("multiLine", True).json(path)
    return rows.where("ats <> '' AND token <> ''").select("company", "ats", F.col("token").alias("board"))


def target_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Targets of tab-separated lines: system, token and, if it differs, company. Blank lines and comments don't count."""
    line = F.trim(F.regexp_replace(col, r"^[\s]+|[\s]+$", ""))
    part = F.split(line, "\t", -1)
    rows = lines.where((line != "") & ~line.startswith("#") & (F.size(part) >= 2))
    return rows.select(F.when(F.size(part) > 2, part[2]).otherwise(part[1]).alias("company"), part[0].alias("ats"), part[1].alias("board"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark, path) if path.endswith(".json") else target_lines(spark.read.text(path))


def benchmark_cases(spark: SparkSession, dataset: str, folder: str) -> DataFrame:
    """Cases of a benchmark with their pages, joined by file name."""
    case = "struct<id:string,file:string,vector:string,malicious:boolean,expected_label:string>"
    rows = spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(dataset).select(F.inline("cases"))
    texts = pages(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "html")
    return rows.join(texts, "file")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the image source; what can't be decoded stays as a row that says so."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
