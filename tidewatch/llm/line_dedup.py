"""Lines repeated across documents, found with a once-seen and a twice-seen Bloom filter.

Three passes over the texts, none of which shuffles a line. The first sets bits for each document's distinct long lines:
a task sends the positions it set, the positions meet by block of the filter, and a bit set from two documents enters the
twice-seen filter. Only lines whose bits are all in that filter are suspected repeats; the second pass shuffles nothing
but their 128-bit digests for the exact count of documents and the document that keeps the line. The third drops lines.
The filter has one size for every input. Beyond that size it lets more lines pass as suspects, which costs digests in the
shuffle and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, texts

MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: Bits of a filter: 2^27 (16 MB, the bound of what is broadcast), in blocks of 2^16.
FILTER_BITS, BLOCK_BITS = 27, 16
PROBES = 2
#: Up to this many repeated lines (16 bytes and an id each) are broadcast to the texts; beyond it they are joined.
SMALL_REPEATS = 500_000
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """What makes lines equal: no white space around, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _digests(text: bytes, min_chars: int) -> dict[bytes, bytes]:
    """Line -> digest of its key, for the distinct lines that are long enough."""
    keys = ((line, line_key(line)) for line in set(text.split(b"\n")) if len(line) >= min_chars)
    return {line: xxhash.xxh3_128_digest(key) for line, key in keys if _long(key, min_chars)}


def _positions(digests: bytes, filter_bits: int) -> np.ndarray:
    """Positions of each 16-byte digest in a filter of 2^filter_bits bits, one column per probe."""
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    probes = halves[:, :1] + halves[:, 1:] * np.arange(PROBES, dtype=np.uint64)
    return (probes >> np.uint64(64 - filter_bits)).astype(np.int64)


def _set_bits(batches: Iterator[pa.RecordBatch], min_chars: int, filter_bits: int) -> Iterator[pa.RecordBatch]:
    """(block, offsets seen once, offsets seen twice) of each batch of documents."""
    for _, documents in texts(batches, "text"):
        own = [_positions(b"".join(set(_digests(text, min_chars).values())), filter_bits).ravel() for text in documents]
        own = [np.unique(x) for x in own]
        at, seen = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
        block = at >> BLOCK_BITS
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(starts[1:], len(at))[: len(starts)]
        low = (at & (2**BLOCK_BITS - 1)).astype(np.uint16)
        rows = [(low[i:j].tobytes(), low[i:j][seen[i:j] > 1].tobytes()) for i, j in zip(starts, ends, strict=True)]
        yield pa.record_batch([pa.array(block[starts], pa.int64()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["block", "once", "twice"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen bits of each block; all rows of a block come one after the other."""
    block, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for at, new, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != block:
                if block is not None and twice.any():
                    yield done()
                block, once, twice = at, np.zeros(2**BLOCK_BITS, bool), np.zeros(2**BLOCK_BITS, bool)
            new = np.frombuffer(new, np.uint16)
            twice[new] |= once[new]
            once[new] = True
            twice[np.frombuffer(again, np.uint16)] = True
    if block is not None and twice.any():
        yield done()


def _suspects(batches: Iterator[pa.RecordBatch], min_chars: int, filter_bits: int, seen_twice: object) -> Iterator[pa.RecordBatch]:
    bits = seen_twice.value
    for batch, documents in texts(batches, "text"):
        ids, digests = [], []
        for key, text in zip(batch.column("id").to_pylist(), documents, strict=True):
            if own := list(set(_digests(text, min_chars).values())):
                at = _positions(b"".join(own), filter_bits)
                hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                found = [own[i] for i in np.flatnonzero(hit)]
                ids += [key] * len(found)
                digests += found
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["id", "digest"])


def _kept(batches: Iterator[pa.RecordBatch], min_chars: int, repeats: object) -> Iterator[pa.RecordBatch]:
    """Each row with its lines counted and dropped. repeats: a broadcast of all repeated lines, or null where the row brings its own."""
    everywhere = repeats.value if repeats is not None else None
    for batch, documents in texts(batches, "text"):
        counts, drops, outs = [], [], []
        brought = batch.column("drop").to_pylist() if everywhere is None else [None] * batch.num_rows
        for key, text, own in zip(batch.column("id").to_pylist(), documents, brought, strict=True):
            lines = text.split(b"\n")
            digests = _digests(text, min_chars) if key is not None else {}
            gone = set(own or ())
            drop = {line for line, d in digests.items() if (d in gone if everywhere is None else everywhere.get(d, key) != key)}
            kept = [line for line in lines if line not in drop] if drop else lines
            counts.append(len(lines))
            drops.append(len(lines) - len(kept))
            outs.append((b"\n".join(kept)).decode())
        names = [n for n in batch.schema.names if n not in ("text", "drop")]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(outs, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], [*names, "text", "n_lines", "n_dropped"])


def repeated_lines(docs: DataFrame, scratch: Scratch, min_chars: int, min_documents: int) -> DataFrame:
    """(digest, keep) of each long line found in enough documents; docs has id and text."""
    spark, filter_bits = docs.sparkSession, FILTER_BITS
    with_id = docs.where("id is not null")
    parts = with_id.mapInArrow(lambda it: _set_bits(it, min_chars, filter_bits), "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_joined, "block long, bits binary")
    # Put together here, as each worker that looks lines up then holds the filter once.
    bits = np.zeros(2 ** (filter_bits - 3), np.uint8)
    for r in merged.toLocalIterator():
        bits[r.block << (BLOCK_BITS - 3) : (r.block + 1) << (BLOCK_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    seen_twice = spark.sparkContext.broadcast(bits)
    suspects = with_id.mapInArrow(lambda it: _suspects(it, min_chars, filter_bits, seen_twice), "id long, digest binary")
    # Rows of one document count once; the partial sums keep a line of a third of all documents to a row per task.
    found = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("keep"))
    return scratch.table(found.where(F.col("documents") >= min_documents).select("digest", "keep"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, small: int = SMALL_REPEATS
) -> DataFrame:
    """docs with text_col reduced, and n_lines (before dropping) and n_dropped.

    A long line, by its key, found in at least min_documents documents stays only in the largest id that holds it, there
    with all its occurrences. Null and empty texts are one empty line and give an empty text. A row with a null id neither
    counts nor loses lines. Repeated rows of one id count as one document each. Columns of docs named n_lines or n_dropped
    are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    repeats = repeated_lines(keyed(docs, id_col, text_col), scratch, min_chars, min_documents)
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)))
    known = None
    if repeats.count() <= small:
        known = spark.sparkContext.broadcast({bytes(r.digest): r.keep for r in repeats.toLocalIterator()})
    else:
        held = keyed(docs, id_col, text_col).where("id is not null").mapInArrow(lambda it: _listed(it, min_chars), "id long, digest binary")
        lost = held.join(repeats, "digest").where("id <> keep").groupBy("id").agg(F.collect_set("digest").alias("drop"))
        plain = plain.join(lost, "id", "left")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name not in ("text", "drop")), "text string", "n_lines long", "n_dropped long"])
    out = plain.mapInArrow(lambda it: _kept(it, min_chars, known), schema)
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"_{i}") for i, c in enumerate(others)}
    return out.select(*(back[c].alias(c) for c in docs.columns if c in back), "n_lines", "n_dropped")


def _listed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch, documents in texts(batches, "text"):
        own = [list(set(_digests(text, min_chars).values())) for text in documents]
        ids = [key for key, x in zip(batch.column("id").to_pylist(), own, strict=True) for _ in x]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([d for x in own for d in x], pa.binary())], ["id", "digest"])
