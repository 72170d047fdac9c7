"""Audit trail: an append-only dataset of JSON lines, one entry per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.schema import AUDIT


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries; nulls are written, so that an open decision stays visible."""
    entries.write.mode("append").option("ignoreNullFields", False).json(path)


def audit_batch_writer(path: str):
    """A ``foreachBatch`` function that appends each micro-batch of entries once.

    Each batch of a query has its own folder and replaces it when it is retried. The id of
    a query stays over restarts from its checkpoint; another query or a new checkpoint has
    another one, so it never meets the entries of an earlier run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("write audit batches from foreachBatch of a stream")
        target = f"{path}/query={query}/batch={batch_id}"
        batch.write.mode("overwrite").option("ignoreNullFields", False).json(target)

    return write


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All entries of both writers; none where the path does not exist. Blank lines are skipped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], AUDIT)
    return spark.read.schema(AUDIT).option("recursiveFileLookup", True).json(path)
