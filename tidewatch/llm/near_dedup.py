"""Near-duplicate documents by banded HyperMinHash registers, confirmed on whole shingle sets.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Each shingle falls into one of the registers; a
register keeps the leading-zero count and some mantissa bits of its smallest value (HyperMinHash), and an empty register
borrows from the first filled one in an order of its own, so that two registers agree with the probability of the sets'
Jaccard similarity. Bands of registers are hashed; documents that share a band are candidates. A candidate pair is first
estimated from the registers, corrected for chance collisions, then confirmed on both full sets.

Documents with equal sets are one class; only its smallest id goes on. Within a band's bucket all pairs are never made:
first every member meets the smallest one, links join into components, then members still apart meet the smallest member
of another component. What is left apart after that is searched by an exact prefix filter: the members' shingles are put
in order from the rarest on, and two sets that are similar enough share one of their first few; where those stand bounds
what the sets can still have in common. Members of one component need no more pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, as_signed, constants, keyed, mix, settle, texts, words_of
from .graph import components

#: 32 bands of 5 registers miss a pair at similarity 0.8 with probability 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
VALUE_BITS, MANTISSA_BITS = 48, 10
#: Chance that two registers of unlike content agree, for this many mantissa bits.
CHANCE = 0.17 / 2**MANTISSA_BITS
#: Estimates this far below the wished similarity are still confirmed: over four standard deviations.
MARGIN = 0.14
#: Ids up to this number (about 30 MB) are broadcast to pick the candidates' texts; beyond it the join is shuffled.
SMALL_IDS = 1_000_000
_BAND_MIX, _SHINGLE_MIX = constants(ROWS + 1, 3), constants(4096, 11)
_ORDERS = np.stack([np.random.default_rng(7 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words the whole sequence is one shingle."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([(words * _SHINGLE_MIX[:n]).sum() + np.uint64(n)], np.uint64))
    total = words[: n - k + 1] * _SHINGLE_MIX[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _SHINGLE_MIX[j]
    return np.unique(mix(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros and mantissa in 16 bits) of a set that isn't empty."""
    value = mix(shingles + np.uint64(0x1234567))
    key = np.sort(((value % np.uint64(REGISTERS)) << np.uint64(VALUE_BITS)) | (mix(value) >> np.uint64(64 - VALUE_BITS)))
    place = (key >> np.uint64(VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    fraction, bits = np.frexp((key[first] & np.uint64(2**VALUE_BITS - 1)).astype(np.float64))
    mantissa = np.where(bits > 0, (fraction * 2 - 1) * 2**MANTISSA_BITS, 0).astype(np.uint16)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[place[first]] = ((VALUE_BITS - bits).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa
    filled[place[first]] = True
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~filled)
        orders = _ORDERS[empty]
        out[empty] = out[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance agreement."""
    return np.clip(((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE), 0, 1)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch, documents in texts(batches, "text", hashes):
        sizes, digests, sketches = [], [], []
        for text in documents:
            shingles = shingle_set(hashes.of(words_of(text)), k)
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            sketches.append(registers(shingles).tobytes() if len(shingles) else None)
        yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["id", "n", "digest", "sketch"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64) * _BAND_MIX[ROWS]
    for batch in batches:
        if batch.num_rows:
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            keys = mix((rows.astype(np.uint64) * _BAND_MIX[:ROWS]).sum(axis=2, dtype=np.uint64) + band)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([as_signed(keys.ravel()), pa.array(ids)], ["band", "id"])


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y) >= least))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch, documents in texts(batches, "text", hashes):
        sets = [shingle_set(hashes.of(words_of(text)), k).tobytes() for text in documents]
        yield pa.record_batch([batch.column("id"), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["id", "digest", "set"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs with the column of both ids as x and y. A much-paired id is split by the adaptive skew join."""
    x = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
    y = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


class _Confirm:
    """Pairs that truly are as similar as wished."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, k: int, percent: int, scratch: Scratch):
        self.docs, self.sketches, self.k, self.percent, self.scratch = docs, sketches, k, percent, scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        least, k, percent = self.percent / 100 - MARGIN, self.k, self.percent
        likely = self.scratch.table(_with_both(pairs, self.sketches, "sketch").mapInArrow(lambda it: _estimated(it, least), "a long, b long"), passing=True)
        ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
        ids = self.scratch.table(ids, passing=True)
        if ids.count() <= SMALL_IDS:
            ids = F.broadcast(ids)
        sets = self.docs.join(ids, "id", "left_semi").mapInArrow(lambda it: _sets(it, k), "id long, digest binary, set binary")
        sets = self.scratch.table(sets.dropDuplicates(["id", "digest"]), passing=True)
        return settle(_with_both(likely, sets, "set").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"))


def _labelled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    labels = components(links)
    rows = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.join(mixed, "band")


def least_common(x: int, y: int, percent: int) -> int:
    """Least number of common members that makes sets of these sizes as similar as percent."""
    return -(-percent * (x + y) // (100 + percent))


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch, documents in texts(batches, "text", hashes):
        for key, text in zip(batch.column("id").to_pylist(), documents, strict=True):
            found = shingle_set(hashes.of(words_of(text)), k)
            whole = np.int64(xxhash.xxh3_64_intdigest(found.tobytes()) >> 1)
            columns = [as_signed(found), *(pa.array(np.full(len(found), v, np.int64)) for v in (key, whole, len(found)))]
            yield pa.record_batch(columns, ["shingle", "id", "whole", "n"])


def _prefix(rows: pa.Table, percent: int) -> pa.Table:
    """The first shingles of one set, from the rarest on, with their places.

    rows lacks the shingles that no other set has. They stand first, and meet nothing.
    """
    size, kept = rows["n"][0].as_py(), ["id", "n", "component", "minor"]
    shingle, at = np.unique(rows["shingle"].to_numpy(), return_index=True)
    order = at[np.argsort(rows["sets"].to_numpy()[at], kind="stable")]
    place = size - len(order) + np.arange(len(order))
    first = place <= size - -(-percent * size // 100)
    place, order = place[first], pa.array(order[first])
    indexed = place <= size - least_common(size, size, percent)
    columns = [rows["shingle"].take(order), pa.array(place), pa.array(indexed), *(rows[c].take(order) for c in kept)]
    return pa.table(columns, names=["shingle", "place", "indexed", *kept])


def _by_prefix(apart: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of all members in different components that may be similar enough, by an exact filter.

    Of two components in a bucket one is not its largest, so one side of a pair is always such a minor member.
    """
    weights = apart.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"))
    members = apart.join(weights, "band").groupBy("id", "component").agg(F.max(F.col("component") != F.col("top.component")).alias("minor"))
    members = scratch.table(members, passing=True)
    ids = members.select("id")
    chosen = docs.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, "id", "left_semi")
    # A repeated row counts twice here, which changes the order for all sets alike.
    rows = scratch.table(chosen.mapInArrow(lambda it: _shingles(it, k), "shingle long, id long, whole long, n long"), passing=True)
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    known = rows.join(shared, "shingle").join(members, "id")
    kind = "shingle long, place long, indexed boolean, id long, n long, component long, minor boolean"
    prefixes = scratch.table(known.groupBy("id", "whole").applyInArrow(lambda t: _prefix(t, percent), kind), passing=True)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        """Probing sets x with the indexed sets y, which are no larger."""
        x, y = (side.select("shingle", *(F.col(c).alias(f"{name}_{c}") for c in ("place", "id", "n", "component"))) for side, name in ((x, "x"), (y, "y")))
        larger = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") > F.col("y_id")))
        # From the first shingle that both have, the rest of either set is all they can have in common.
        rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
        enough = rest * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
        near = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("x_component") != F.col("y_component")) & larger & enough)
        return near.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    indexed = prefixes.where("indexed")
    return met(prefixes.where("minor"), indexed).union(met(prefixes.where("not minor"), indexed.where("minor"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component, kept) per row: the size of its shingle set, the smallest id reachable over links of
    documents with a Jaccard similarity of at least percent / 100, and whether that is the row itself.

    Null and empty texts, and texts without words, have 0 shingles and are their own component. A null id links with
    nothing: its component is null and the row is kept. Repeated rows of one id give a row each and share a component;
    where their texts differ, the id is linked with whatever one of its texts is linked with. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = keyed(docs, id_col, text_col)
    signed = scratch.table(base.mapInArrow(lambda it: _signed(it, k), "id long, n long, digest binary, sketch binary"))
    known = signed.where("id is not null and n > 0")
    classes = scratch.table(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    bands = scratch.table(classes.select("id", "sketch").mapInArrow(_banded, "band long, id long"), passing=True)
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.table(bands.join(hubs, "band").select("band", "id", "hub"), passing=True)
    confirm = _Confirm(base.where("id is not null"), classes, k, percent, scratch)
    star = buckets.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    # Rows of one id that differ are one document: their classes are linked.
    several = known.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    same = known.join(several, "id").join(classes.select("digest", F.col("id").alias("b")), "digest").where("id <> b")
    links = settle(confirm(star).union(same.select(F.col("id").alias("a"), "b").distinct()))
    tested = star
    for last in (False, True):
        apart = scratch.table(_labelled(buckets.select("band", "id"), links), passing=True)
        if last:
            pairs = _by_prefix(apart, confirm.docs, k, percent, scratch)
        else:
            pivot = apart.where("component > low").groupBy("band").agg(F.min(F.struct("component", "id")).alias("pivot"))
            pairs = apart.join(pivot, "band").where("component <> pivot.component").select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, passing=True)
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        links = settle(links.union(confirm(pairs)))
    labels = components(links).select(F.col("node").alias("first"), "component")
    owners = classes.select("digest", F.col("id").alias("first")).join(labels, "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    out = signed.select("id", "n", "digest").join(settle(owners), "digest", "left")
    scratch.clear()
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
