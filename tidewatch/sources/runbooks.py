"""Runbook corpus: Markdown files with front matter, one per anomaly type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import front_matter, front_matter_value


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the Markdown files in a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def runbook_index(files: DataFrame) -> DataFrame:
    """(anomaly_type, title, body, path) of (path, content) rows; the last path of a type wins.

    The winners are found by type and path alone, so no text is shuffled but theirs. Paths are unique.
    """
    parsed = files.select("path", front_matter(F.col("content")).alias("f"))
    typed = parsed.select(
        "path",
        front_matter_value(F.col("f.head"), "anomaly_type").alias("anomaly_type"),
        front_matter_value(F.col("f.head"), "title").alias("title"),
        F.col("f.body").alias("body"),
    ).filter(F.col("anomaly_type").isNotNull() & (F.col("anomaly_type") != ""))
    winners = typed.groupBy("anomaly_type").agg(F.max("path").alias("path"))
    return typed.join(winners, ["anomaly_type", "path"]).select("anomaly_type", "title", "body", "path")


def list_runbooks(index: DataFrame) -> DataFrame:
    return index.select("anomaly_type").orderBy("anomaly_type")
