"""Directly addressable codes: token ids in chunk levels, with any token in reach without decoding others.

A dataset is a folder with two tables that Spark writes, so it works on any store and a lost task leaves nothing behind:

segments: part, segment (place within the part), before (ids of the part ahead of it), ids and lengths of its documents,
    n_tokens, and the code: levels (the ids' 8-bit chunks, lowest first; a level holds the ids that reach it), marks (a
    bit per entry of a level, set where the id goes on in the next level; the last level has none) and ranks (the number
    of set marks ahead of every 512th entry, as 32-bit numbers).
parts: part, start (ids of all parts ahead of it) - as many rows as there are parts.

The documents stand in ascending order of their ids over parts and segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, texts
from .tokens import WordTokenizer

CHUNK_BITS, RANK_STEP = 8, 512
#: A segment is closed once it holds this many ids; a document is never parted.
SEGMENT_TOKENS = 1_000_000
SEGMENTS = "part int, segment int, before long, ids array<long>, lengths array<long>, n_tokens long, levels array<binary>, marks array<binary>, ranks array<binary>"


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, marks, ranks) of unsigned 32-bit ids."""
    levels, marks, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & np.uint32(2**CHUNK_BITS - 1)).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(CHUNK_BITS)
        goes_on = rest > 0
        if not goes_on.any():
            return levels, marks, ranks
        marks.append(np.packbits(goes_on).tobytes())
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_STEP), dtype=np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes())
        rest = rest[goes_on]


def decode(levels: list[bytes], marks: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for level, bits in zip(levels[-2::-1], marks[::-1], strict=True):
        low = np.frombuffer(level, np.uint8).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(low)).astype(bool)
        low[goes_on] |= out << np.uint32(CHUNK_BITS)
        out = low
    return out


def access(levels: list[bytes], marks: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The ids at these places of a segment; each costs a look at its chunks and at most 64 bytes of marks per level."""
    out, place, rows = np.zeros(len(at), np.uint32), at.astype(np.int64), np.arange(len(at))
    for depth, level in enumerate(levels):
        out[rows] |= np.frombuffer(level, np.uint8)[place].astype(np.uint32) << np.uint32(CHUNK_BITS * depth)
        if depth == len(marks):
            break
        bits, ahead = np.frombuffer(marks[depth], np.uint8), np.frombuffer(ranks[depth], "<u4")
        go = ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)
        rows, place = rows[go], place[go]
        block = place // RANK_STEP
        within = [int(np.unpackbits(bits[b * RANK_STEP // 8 : p // 8 + 1], count=p - b * RANK_STEP).sum()) for b, p in zip(block.tolist(), place.tolist(), strict=True)]
        place = ahead[block].astype(np.int64) + np.array(within, np.int64)
    return out


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer, last = WordTokenizer(path), np.array([end], "<u2").tobytes()
    for batch, documents in texts(batches, "text", tokenizer):
        codes = [ids + last for ids in tokenizer.ids(documents)]
        yield pa.record_batch([batch.column("id"), pa.array(codes, pa.binary())], ["id", "codes"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, segment, before = TaskContext.get().partitionId(), 0, 0
    ids, codes, size = [], [], 0

    def done() -> pa.RecordBatch:
        arrays = [np.frombuffer(c, "<u2") for c in codes]
        tokens = np.concatenate(arrays)
        row = {"part": part, "segment": segment, "before": before, "ids": ids, "lengths": [len(a) for a in arrays], "n_tokens": len(tokens)}
        row |= dict(zip(("levels", "marks", "ranks"), encode(tokens), strict=True))
        kinds = [("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64())]
        return pa.RecordBatch.from_pylist([row], pa.schema(kinds + [(n, pa.list_(pa.binary())) for n in ("levels", "marks", "ranks")]))

    for batch in batches:
        for key, code in zip(batch.column("id").to_pylist(), batch.column("codes").to_pylist(), strict=True):
            ids.append(key)
            codes.append(code)
            size += len(code) // 2
            if size >= SEGMENT_TOKENS:
                yield done()
                segment, before = segment + 1, before + size
                ids, codes, size = [], [], 0
    if ids:
        yield done()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every whole text, each followed by the end id, in ascending order of the ids.

    Null and empty texts have only the end id. A null id stands first. Repeated rows are all written, in the order of
    their ids. An empty table gives a dataset without segments.
    """
    spark = docs.sparkSession
    # Codes are written and dealt by range, not texts: they are smaller, tasks are those of the scan, and the sampling of
    # a range, which reads its input once more, does not tokenize again.
    scratch = Scratch(spark)
    codes = scratch.table(keyed(docs, id_col, text_col).mapInArrow(lambda it: _tokenized(it, tokenizer, end), "id long, codes binary"), passing=True)
    ordered = codes.repartitionByRange("id").sortWithinPartitions("id", "codes")
    ordered.mapInArrow(_segments, SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    scratch.clear()
    sizes = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *(r.n for r in sizes)])
    rows = [(r.part, int(s)) for r, s in zip(sizes, starts, strict=False)]
    spark.createDataFrame(rows, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the start of their part; the directory has a row per part and is broadcast."""
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(F.broadcast(parts), "part")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tokens, lengths = decode(row["levels"], row["marks"]), np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            pieces = [tokens[i:j].astype("<u4").tobytes() for i, j in zip(ends - lengths, ends, strict=True)]
            starts = row["start"] + row["before"] + ends - lengths
            yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(pieces, pa.binary())], ["id", "start", "n_tokens", "tokens"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) per document of a dataset; tokens are little-endian unsigned 32-bit numbers."""
    needed = _opened(spark, path).select("start", "before", "ids", "lengths", "levels", "marks")
    return needed.mapInArrow(_documents, "id long, start long, n_tokens long, tokens binary")


def _accessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            wanted = np.array(sorted(row["wanted"]), np.int64)
            found = access(row["levels"], row["marks"], row["ranks"], wanted - row["first"])
            yield pa.record_batch([pa.array(wanted), pa.array(found.astype(np.int64))], ["position", "token"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """(position, token) for each distinct position of the whole dataset that positions names; others give no row."""
    first = F.col("start") + F.col("before")
    index = _opened(spark, path).select("part", "segment", first.alias("first"), (first + F.col("n_tokens")).alias("last"))
    parts = index.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    wanted = positions.select(F.col(column).cast("long").alias("position")).where("position is not null").distinct()
    # A row per part, as in the dataset's own directory: safe to broadcast.
    placed = wanted.join(F.broadcast(parts), F.expr("position >= low and position < high")).select("part", "position")
    by_segment = placed.join(index, "part").where("position >= first and position < last").groupBy("part", "segment", "first").agg(F.collect_list("position").alias("wanted"))
    code = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").select("part", "segment", "levels", "marks", "ranks")
    return code.join(by_segment, ["part", "segment"]).mapInArrow(_accessed, "position long, token long")
