"""What the operators of this subpackage share: shared scratch tables, word hashes, small Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers that mix 64-bit numbers (fixed values of a public mixing function).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15
#: Entries that a task keeps in one table of words before it starts a new one.
WORD_CACHE = 400_000
#: Text that a task works on at a time.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set, as in tests on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        set_path = context.getConf().get("spark.checkpoint.dir", None)
        if not set_path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(set_path or tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder, so that later steps reread them instead of computing them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_folder(spark), []

    def table(self, df: DataFrame, passing: bool = False) -> DataFrame:
        """df, written and read back. passing: clear() removes it, once what was made of it is itself written."""
        path = f"{self.root}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if passing:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = []


def settle(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number of x, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    start = np.uint64((seed * STEP) % 2**64)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, parted by space and the control characters 9 to 13, as bytes do both."""
    return text.lower().split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null becomes empty."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, SLICE_BYTES of text and one more row at a time."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    starts = np.flatnonzero(np.diff(before // SLICE_BYTES, prepend=-1)).tolist()
    for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(i, j - i)


def give_back() -> None:
    """Hand what this process has freed back to the system: workers outlive their tasks, and allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def texts(batches: Iterator[pa.RecordBatch], column: str, *tables: dict) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, in slices: what a task makes of its texts at a time does not grow with Spark's batches.

    tables of the task are emptied after the last text, so that no later task or stage pays for them.
    """
    give_back()
    for batch in batches:
        for rows in _slices(batch, column) if batch.num_rows else (batch,):
            yield rows, as_bytes(rows.column(column))
    for table in tables:
        table.clear()
    give_back()


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text, under fixed names, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
