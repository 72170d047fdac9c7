"""Merkle manifest of a table: one binary hash tree per value of a column, and one tree over their roots.

Leaves are numbered within their tree by a range sort and the counts of the partitions before. Aligned runs of
2**height leaves are subtrees; a task builds one of them in an array laid out after van Emde Boas: the upper half of its
levels first, then each subtree of the lower half, split the same way again. Node addresses come from arithmetic alone, for
building as for reading siblings. The roots of the subtrees are the leaves of the next round, until each tree has one root;
the trees' roots go through the same rounds once more. Proofs are read from the top round down: a subtree's leaves get
the siblings inside it, followed by those of its root, so nothing is ever grouped beyond one subtree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Levels below the root of a stored subtree: 1,024 leaves, 64 KiB of digests.
HEIGHT = 10
_WIDTH = 32


def digest(*columns: Column) -> Column:
    """SHA-256 (hex) of values, each as its UTF-8 length, a colon and itself, or '-' if it is null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def join_digests(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def address(levels: int, depth: int, index: int) -> int:
    """Place of a node in the layout of a complete binary tree of so many levels (the root has depth 0)."""
    upper = levels // 2
    if levels == 1:
        return 0
    if depth < upper:
        return address(upper, depth, index)
    lower, down = levels - upper, depth - upper
    subtree, inside = index >> down, index & ((1 << down) - 1)
    return (1 << upper) - 1 + subtree * ((1 << lower) - 1) + address(lower, down, inside)


@lru_cache(maxsize=64)
def layout(levels: int) -> list[list[int]]:
    """Places of all nodes, by depth."""
    return [[address(levels, depth, i) for i in range(1 << depth)] for depth in range(levels)]


def levels_of(count: int, height: int) -> int:
    """Levels that a subtree of a tree with count nodes in this round goes through: all, or as many as make one root."""
    return height if count > 1 << height else max(0, (count - 1).bit_length())


def store(leaves: list[str], rise: int) -> bytes:
    """The subtree over leaves as one array of digests; it rises so many levels, and absent nodes are zeros."""
    place, out = layout(rise + 1), bytearray(((2 << rise) - 1) * _WIDTH)
    nodes = leaves
    for depth in range(rise, -1, -1):
        for at, node in zip(place[depth], nodes, strict=False):
            out[at * _WIDTH : (at + 1) * _WIDTH] = bytes.fromhex(node)
        nodes = [join_digests(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return bytes(out)


class Block:
    """Reads a stored subtree by address arithmetic."""

    def __init__(self, digests: bytes, rise: int, leaves: int):
        self.digests, self.rise, self.leaves, self.place = digests, rise, leaves, layout(rise + 1)

    def node(self, depth: int, index: int) -> str:
        at = self.place[depth][index] * _WIDTH
        return self.digests[at : at + _WIDTH].hex()

    def siblings(self, leaf: int) -> list[str]:
        """Per level from the leaf up: the sibling behind the side it stands on ('l' or 'r'), or '-' if there is none."""
        out, index, nodes = [], leaf, self.leaves
        for depth in range(self.rise, 0, -1):
            other = index ^ 1
            out.append("-" if other >= nodes else ("l" if other < index else "r") + self.node(depth, other))
            index, nodes = index >> 1, (nodes + 1) >> 1
        return out


def fold(node: str, steps: list[str]) -> str:
    """The root that a node and its siblings give."""
    for step in steps:
        if step == "-":
            node = join_digests(node)
        elif step[0] == "l":
            node = join_digests(step[1:], node)
        else:
            node = join_digests(node, step[1:])
    return node


@dataclass
class Manifest:
    """Tables of a manifest in its folder: numbered leaves, stored subtrees of all rounds, and the root of all."""

    spark: SparkSession
    path: str
    height: int
    rounds: int
    top_rounds: int
    root: str | None

    def blocks(self, name: str, r: int) -> DataFrame:
        """Subtrees of a round; name is trees, or top for the tree over the trees' roots."""
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/{name}-{r}")


_BLOCK = "tree string, block long, rise int, leaves int, size long, root string, digests binary"


def _whole(height: int) -> Column:
    """The subtree is a tree of its own."""
    return F.col("size") <= (1 << height)


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (tree, id, digest, ...) with at, their place in their tree by id, then digest, and size, the tree's leaves.

    The sorted partitions are written once, so that places and counts come from the same rows even after a lost executor.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marked = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("place", place)
    settled = scratch.table(marked, passing=True)
    runs = settled.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # At most one row per tree and partition: a window holds no more rows of a tree than there are partitions.
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    offsets = runs.select("tree", "part", offset.alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return settled.join(offsets, ["tree", "part"]).withColumn("at", F.col("place") + F.col("offset")).drop("part", "place", "offset")


def _stored(nodes: pa.Table, height: int) -> pa.Table:
    nodes = nodes.sort_by("at")
    size, count, first = nodes["size"][0].as_py(), nodes.num_rows, nodes["at"][0].as_py()
    rise = levels_of(size, height)
    digests = store(nodes["digest"].to_pylist(), rise)
    at = address(rise + 1, 0, 0) * _WIDTH
    row = {"tree": nodes["tree"][0].as_py(), "block": first >> height, "rise": rise, "leaves": count, "size": size, "root": digests[at : at + _WIDTH].hex(), "digests": digests}
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _raise(nodes: DataFrame, manifest: Manifest, name: str) -> int:
    """Write the rounds of stored subtrees over nodes (tree, at, size, digest) as name-1, name-2, ...; how many."""
    done, height = 0, manifest.height
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while done == 0 or largest > 1:
        done += 1
        groups = nodes.groupBy("tree", F.shiftright("at", height))
        groups.applyInArrow(lambda t: _stored(t, height), _BLOCK).write.parquet(f"{manifest.path}/{name}-{done}")
        # Trees that have one root by now leave; the roots of the others are the next round's leaves.
        up = F.shiftright(F.col("size") + (1 << height) - 1, height)
        nodes = manifest.blocks(name, done).where(~_whole(height)).select("tree", F.col("block").alias("at"), up.alias("size"), F.col("root").alias("digest"))
        largest = -(-largest >> height) if largest > 1 << height else 1
    return done


def _roots(manifest: Manifest, name: str, rounds: int) -> DataFrame:
    """(tree, root) of all trees, each from the round in which it became one."""
    parts = [manifest.blocks(name, r).where(_whole(manifest.height)).select("tree", "root") for r in range(1, rounds + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build(leaves: DataFrame, id_col: str, tree_col: str, leaf_col: str, path: str, claimed_col: str | None = None, height: int = HEIGHT) -> Manifest:
    """Write the manifest of leaves (hex SHA-256 digests in leaf_col) under path.

    In each tree (value of tree_col; null is a tree of its own) leaves stand by id, null first, then by digest: rows of one
    id that differ stand by their digests, and equal rows are interchangeable. On each level every two consecutive
    nodes become the digest of both, a last single one that of itself, until one is left. The trees' roots, by tree (null
    first, then bytewise), give the root in the same way. An empty table has no root. claimed_col: digests that verify()
    takes for the leaves where they are not null. Other columns are not read, whatever their names.
    """
    spark = leaves.sparkSession
    # A text that is never null, and sorts null first.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{tree_col}`").cast("string")), F.lit("0"))
    claimed = F.coalesce(F.col(f"`{claimed_col}`"), F.col(f"`{leaf_col}`")) if claimed_col else F.col(f"`{leaf_col}`")
    plain = leaves.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("digest"), claimed.alias("claimed"))
    # A range sort reads its rows twice; hashing whole texts once is enough.
    scratch = Scratch(spark)
    numbered = _numbered(scratch.table(plain, passing=True), scratch)
    numbered.write.parquet(f"{path}/leaves")
    manifest = Manifest(spark, path, height, 0, 0, None)
    manifest.rounds = _raise(spark.read.schema(numbered.schema).parquet(f"{path}/leaves"), manifest, "trees")
    # One tree over the trees' roots, whose order is that of the trees.
    subroots = _roots(manifest, "trees", manifest.rounds).select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"))
    top = _numbered(subroots, scratch)
    top.write.parquet(f"{path}/top-leaves")
    scratch.clear()
    manifest.top_rounds = _raise(spark.read.schema(top.schema).parquet(f"{path}/top-leaves"), manifest, "top")
    root = _roots(manifest, "top", manifest.top_rounds).first()
    manifest.root = root["root"] if root else None
    return manifest


def _with_paths(nodes: pa.Table, blocks: pa.Table, height: int, folds: bool) -> pa.Table:
    """nodes of one subtree with the path to the root of all, and the subroot: their siblings, then those of their subtree's root."""
    stored = blocks.to_pylist()[0] if blocks.num_rows and nodes.num_rows else None
    paths = []
    if stored:
        block = Block(stored["digests"], stored["rise"], stored["leaves"])
        above, first = stored["path"].split(), stored["block"] << height
        paths = [[*block.siblings(at - first), *above] for at in nodes["at"].to_pylist()]
    else:
        nodes = nodes.slice(0, 0)
    subroots = pa.array([stored["subroot"]] * len(paths) if stored else [], pa.string())
    if not folds:
        return nodes.append_column("path", pa.array([" ".join(p) for p in paths], pa.string())).append_column("subroot", subroots)
    siblings = pa.array(["".join(step[1:] for step in p) for p in paths], pa.string())
    folded = pa.array([fold(leaf, p) for leaf, p in zip(nodes["claimed"].to_pylist(), paths, strict=True)], pa.string())
    return nodes.drop_columns(["claimed"]).append_column("subroot", subroots).append_column("siblings", siblings).append_column("folded", folded)


def _join_paths(nodes: DataFrame, blocks: DataFrame, height: int, folds: bool = False) -> DataFrame:
    """Bring nodes (tree, at, ...) together with their subtree, which is one group of at most 2**height rows."""
    kept = [f for f in nodes.schema if f.name != "claimed" or not folds]
    added = ["subroot", "siblings", "folded"] if folds else ["path", "subroot"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{a} string" for a in added])
    grouped = nodes.groupBy("tree", F.shiftright("at", height).alias("_block")).cogroup(blocks.groupBy("tree", F.col("block").alias("_block")))
    return grouped.applyInArrow(lambda a, b: _with_paths(a, b, height, folds), schema)


def _first_blocks(manifest: Manifest, name: str, rounds: int, above: DataFrame) -> DataFrame:
    """Subtrees of the first round with the path of their roots and their tree's root; above: (tree, path, subroot) of whole trees."""
    height, paths = manifest.height, None
    for r in range(rounds, 0, -1):
        stored = manifest.blocks(name, r)
        own = stored.where(_whole(height)).join(above, "tree")
        if paths is not None:
            inner = stored.where(~_whole(height)).join(paths.withColumnRenamed("at", "block"), ["tree", "block"])
            own = own.unionByName(inner)
        if r > 1:
            nodes = manifest.blocks(name, r - 1).where(~_whole(height)).select("tree", F.col("block").alias("at"))
            paths = _join_paths(nodes, own, height)
    return own


def verify(manifest: Manifest) -> DataFrame:
    """Per leaf: id, tree, leaf, subroot, root, siblings, folded, verified.

    siblings: the digests of the leaf's siblings from its level up to the root of all, joined. folded: the root that the
    claimed leaf (where there is none, the leaf itself) and these siblings give; verified: whether that is the root.
    Repeated rows stay repeated. An empty manifest gives an empty table.
    """
    spark, height = manifest.spark, manifest.height
    start = spark.createDataFrame([("", "", "")], "tree string, path string, subroot string")
    top_leaves = spark.read.parquet(f"{manifest.path}/top-leaves").select("tree", "at", F.col("id").alias("name"), "digest")
    top = _join_paths(top_leaves, _first_blocks(manifest, "top", manifest.top_rounds, start), height)
    trees = top.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    leaves = spark.read.parquet(f"{manifest.path}/leaves").select("tree", "at", "id", "digest", "claimed")
    out = _join_paths(leaves, _first_blocks(manifest, "trees", manifest.rounds, trees), height, folds=True)
    name = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)"))
    root = F.lit(manifest.root).cast("string")
    return out.select("id", name.alias("tree"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "siblings", "folded", (F.col("folded") == root).alias("verified"))
