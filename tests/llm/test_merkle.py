import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import contracts, merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    fields = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """All levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def walk(levels, at, node):
    """(siblings, root folded from node)"""
    siblings = []
    for level in levels[:-1]:
        pair = level[at // 2 * 2 : at // 2 * 2 + 2]
        siblings += [x for i, x in enumerate(pair) if i != at % 2]
        pair[at % 2] = node
        node, at = h(*pair), at // 2
    return siblings, node


def model(rows):
    """Tuples of the query's columns, row by row."""
    if not rows:
        return []
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {lang: sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in order[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    root = top[-1][0]
    out = []
    for i, lang in enumerate(langs):
        for at, r in enumerate(order[lang]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            low, node = walk(trees[lang], at, leaf(r, int(tampered)))
            high, node = walk(top, i, node)
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], root, h(*low, *high), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tree string, at int"
    data = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in rows]
    spark.createDataFrame(data, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = contracts.op13_merkle_manifest(spark, str(tmp_path))
    assert set(COLUMNS) <= set(out.columns)
    found = [tuple(r) for r in out.select(*COLUMNS).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(model(rows), key=key)


def row(i, lang="en", text="some text", n_chars=9, source="s"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


@pytest.mark.parametrize("height", [2, 10])
def test_equals_brute_force(spark, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle.build, "__defaults__", (None, height))
    rows = [row(i * 3, "en", f"text {i} é") for i in range(41)] + [row(i, "de") for i in range(17)] + [row(i, "z") for i in (1, 2, 3)] + [row(900, "é")]
    rows += [row(1000 + i, None, None if i % 2 else "", None if i < 4 else 7, None) for i in range(8)]
    # One id twice with unlike texts, one row thrice, a null id, a text much longer than the others.
    rows += [row(3, "en", "other"), row(6, "en", "same"), row(6, "en", "same"), row(6, "en", "same"), row(None, "en"), row(5000, "de", "word " * 200_000, 1_000_000)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[row(7)], [row(7), row(7)], [row(i) for i in range(5)]])
def test_small_tables(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_layout_is_recursive():
    # Four levels: the upper two, then four subtrees of two levels each.
    assert merkle.layout(4) == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]
    for levels in range(1, 12):
        assert sorted(p for depth in merkle.layout(levels) for p in depth) == list(range(2**levels - 1))


def test_a_fold_finds_any_change(spark, tmp_path):
    leaves = spark.range(30).select("id", F.lit("x").alias("lang"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    claims = leaves.withColumn("claimed", F.when(F.col("id") == 11, F.sha2(F.lit(b"other"), 256)))
    manifest = merkle.build(claims, "id", "lang", "leaf", str(tmp_path / "m"), claimed_col="claimed", height=2)
    assert [r.id for r in merkle.verify(manifest).where("not verified").collect()] == [11]
