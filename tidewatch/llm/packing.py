"""Best-fit packing of token sequences in bulk rounds over sorted documents and gaps.

Documents longer than a sequence are cut. Pieces are sorted by length over the cluster and ranked among those of equal
length, which are interchangeable. Rounds then take the lengths from the longest down: the round's pieces meet the gaps
left so far, swept from the smallest gap that holds them to larger ones; where many want one gap, ranks decide, one run
of equal gaps at a time; the gaps shrink and the next round follows. Pieces that find no gap open new sequences.

Lengths and gaps are numbers up to the sequence length, so what the rounds hold is a count per length and runs of equal
gaps: its size depends on the sequence length and not on the number of documents. Each piece then looks up its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, keyed, texts
from .tokens import WordTokenizer

SEQUENCE_TOKENS = 2048


def best_fit(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, runs (first rank, first sequence, pieces of this length per sequence, offset), ascending by rank."""
    gaps: list[int] = []  # sizes of gaps there are, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences)
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank, rows = counts[length], 0, []
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = gap // length
            whole = min(number, left // each)
            rest = 0 if whole == number else left - whole * each
            rows.append((rank, first, each, capacity - gap))
            put(gap - each * length, first, whole)
            if rest:
                put(gap - rest * length, first + whole, 1)
            used = whole + (rest > 0)
            put(gap, first + used, number - used)
            left -= whole * each + rest
            rank += whole * each + rest
        plan[length] = rows
    return plan


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tokenizer, last = WordTokenizer(path), np.array([end], "<u2").tobytes()
    for batch, documents in texts(batches, "text", tokenizer):
        rows = []
        for key, codes in zip(batch.column("id").to_pylist(), tokenizer.ids(documents), strict=True):
            tokens = np.frombuffer(codes + last, "<u2").astype("<u4")
            for piece, start in enumerate(range(0, len(tokens), capacity)):
                part = tokens[start : start + capacity]
                rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "crc"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank among the pieces of equal length in this partition, which is sorted by length."""
    part, length, rank = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ranks = []
        for x in batch.column("length").to_pylist():
            rank, length = (rank + 1, length) if x == length else (0, x)
            ranks.append(rank)
        yield pa.record_batch([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], [*batch.schema.names, "part", "rank"])


def _placed(batches: Iterator[pa.RecordBatch], plan: object) -> Iterator[pa.RecordBatch]:
    ahead, runs = plan.value
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths, part, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "part", "rank"))
        pairs, which = np.unique(np.stack([part, lengths]), axis=1, return_inverse=True)
        rank = rank + np.array([ahead[p, n] for p, n in pairs.T.tolist()], np.int64)[which.ravel()]
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for length in np.unique(lengths).tolist():
            of = lengths == length
            table = runs[length]
            run = table[np.searchsorted(table[:, 0], rank[of], side="right") - 1]
            sequence[of] = run[:, 1] + (rank[of] - run[:, 0]) // run[:, 2]
            offset[of] = run[:, 3] + (rank[of] - run[:, 0]) % run[:, 2] * length
        yield pa.record_batch([*(batch.column(c) for c in ("id", "piece", "start", "length", "crc")), pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) per piece of every document's ids and the end id after them.

    Null and empty texts are the end id alone. Null ids and repeated rows are packed like any other row. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    cut = keyed(docs, id_col, text_col).mapInArrow(lambda it: _pieces(it, tokenizer, end, capacity), "id long, piece int, start long, length long, crc long")
    # Written first, as the sampling of a range reads its input once more.
    scratch = Scratch(spark)
    ordered = scratch.table(cut, passing=True).repartitionByRange("length", "id", "piece").sortWithinPartitions("length", "id", "piece")
    table = scratch.table(ordered.mapInArrow(_ranked, "id long, piece int, start long, length long, crc long, part int, rank long"))
    scratch.clear()
    # Sorted by length, a partition shares lengths with its neighbours only: as many rows as partitions and lengths together.
    sizes = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", "n", F.coalesce(earlier, F.lit(0)).alias("ahead")).collect()
    counts: dict[int, int] = {}
    for r in sizes:
        counts[r.length] = counts.get(r.length, 0) + r.n
    runs = {length: np.array(rows, np.int64) for length, rows in best_fit(counts, capacity).items()}
    plan = spark.sparkContext.broadcast(({(r.part, r.length): r.ahead for r in sizes}, runs))
    return table.mapInArrow(lambda it: _placed(it, plan), "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
