"""A corpus made ready for training: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tidewatch.llm.common import read, settle, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the chance that its label is 1 reaches this.
MIN_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents that are there.

    A null text is judged as an empty one. Null ids and repeated rows are judged by their texts, each row for itself;
    without any label every document stays. Texts are read whole. An empty table gives an empty one.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= MIN_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat; n_chars follows the text.

    Every row stays: a null text becomes empty, rows of one id share their fate, and a row without an id loses nothing and
    counts for nothing. Lines are compared whole, however long. An empty table gives an empty one.
    """
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null, empty and other texts without words all stay, and so do all rows without an id, which are near nothing. Rows of
    one id are one document: of several the one with the least text stays (null first). Nothing stays of an empty table.
    """
    marked = near_dedup.near_duplicates(docs, k=5, percent=80).where("kept and id is not null")
    rows = settle(marked.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows")))
    once = docs.join(rows.where("rows = 1"), "doc_id", "left_semi").select(*COLUMNS)
    least = F.min(F.struct("text", *(c for c in COLUMNS if c not in ("doc_id", "text")))).alias("row")
    repeated = docs.join(rows.where("rows > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "row.*")
    unnamed = docs.where("doc_id is null").select(*COLUMNS)
    return once.unionByName(repeated.select(*COLUMNS)).unionByName(unnamed)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay. Null ids and repeated rows are judged by their texts, each row for itself.
    Texts are searched whole. Without items every document stays; an empty table gives an empty one.
    """
    return decontaminate.find_items(docs, read(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the training sequences.

    Null and empty texts are packed as their end id alone; null ids and repeated rows like any other row. A text longer
    than a sequence is cut into pieces, all of which are packed. An empty table gives an empty one.
    """
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=0, capacity=2048)
    return out.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]
#: The classifier, the tokenizer and the edit search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
