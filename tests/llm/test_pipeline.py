"""Each stage of the pipeline against a brute-force version, on what the stage before kept."""

import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tidewatch.llm import decontaminate

from . import brute

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Stage -> (rows in, rows out), written and read again between the stages."""
    root, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = f"file://{root}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def by_id(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_keep_the_columns(steps):
    assert list(steps) == [name for name, _ in pipeline.STAGES]
    assert all(steps[name][2] == list(pipeline.COLUMNS) for name in list(steps)[:-1])


def test_quality_keeps_good_documents_and_drops_bad_ones(spark, steps):
    kept = by_id(steps["quality"][1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in kept) == bool(r.quality) for r in labels if r.quality is not None]
    assert np.mean(right) > 0.95
    assert kept.items() <= by_id(steps["quality"][0]).items()


def test_line_dedup_equals_brute_force(steps):
    before, after, _ = steps["line_dedup"]
    expected = {i: text for i, _, _, text in brute.deduped([(r.doc_id, r.text) for r in before])}
    assert by_id(after) == expected
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_dedup_equals_brute_force(steps):
    before, after, _ = steps["near_dedup"]
    roots = brute.near(by_id(before), 5, 80)
    assert by_id(after) == {i: t for i, t in by_id(before).items() if roots[i][1] == i}


def test_decontamination_equals_brute_force(spark, steps):
    before, after, _ = steps["decontaminate"]
    plain = lambda t: b" ".join(decontaminate.tokens_of((t or "").encode())).decode()
    items = [x for x in (plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if x]
    # The distance itself is held against the plain program in test_decontaminate.
    clean = {i: t for i, t in by_id(before).items() if all(decontaminate.distance_within(x, plain(t))[0] > int(decontaminate.MAX_EDITS * len(x)) for x in items)}
    assert clean.items() <= by_id(after).items()
    assert len(after) - len(clean) <= 0.05 * (len(before) - len(clean))


def test_packing_is_whole_and_tight(steps):
    before, after, _ = steps["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = set(), 0
    for r in before:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        expected |= {(r.doc_id, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after} == expected and len(after) == len(expected)
    sequences = {}
    for r in after:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in sequences.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0, *(n for _, n in rows)])[:-1].tolist() and sum(n for _, n in rows) <= 2048
    assert len(sequences) <= 1.05 * -(-total // 2048)


def test_run_equals_the_stages(spark, steps):
    out = pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps["packing"][1])


def _docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def test_near_stage_keeps_rows_without_ids_and_one_row_of_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, other), (None, None), (5, text), (5, text), (9, text), (9, other), (12, other), (20, None), (21, ""), (22, None)]
    rows += [(30, "a text of its own, " + other[:20]), (30, "another text of its own, " + text[:20])]
    kept = [(r.doc_id, r.text) for r in pipeline.near_stage(spark, _docs(spark, rows), SF).collect()]
    # 9 is near 5 by one of its texts, and 12 near 9 by the other.
    assert sorted(kept, key=str) == sorted([(None, text), (None, other), (None, None), (5, text), (20, None), (21, ""), (22, None), (30, "a text of its own, " + other[:20])], key=str)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Null ids and texts, empty and very long texts, repeated rows; and an empty table."""
    stage, long = dict(pipeline.STAGES)[name], "A sentence of many words that goes on. " * 5000
    rows = [(None, "no id here, but a text"), (None, None), (1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (7, "short text"), (7, "short text")]
    out = stage(spark, _docs(spark, rows), SF)
    assert out.count() <= (len(rows) if name != "packing" else 10_000)
    if name in ("line_dedup", "decontaminate"):
        assert out.count() == len(rows)
    if name == "near_dedup":
        assert out.count() == 7
    empty = stage(spark, _docs(spark, rows).limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0
