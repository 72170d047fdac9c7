import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import line_dedup

from . import brute


def lines(rng, n):
    pool = [f"Line number {i} that many of the documents repeat word for word" for i in range(12)] + ["short", "", "é" * 39, "é" * 40, "é" * 41]
    return "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool).replace("L", rng.choice("lL")) + rng.choice(["", "\r"]) for _ in range(n))


@pytest.mark.parametrize("small", [500_000, 0])
def test_equals_brute_force(spark, small):
    rng = random.Random(9)
    docs = [(i, lines(rng, rng.randrange(1, 9))) for i in range(60)]
    docs += [(None, docs[0][1]), (70, None), (71, ""), (72, "\n\n"), (5, docs[5][1]), (73, "own line " * 30_000 + "\n" + docs[1][1])]
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, n_lines int, id string").repartition(7)
    out = line_dedup.drop_repeated_lines(df, small=small)
    assert out.columns == ["text", "doc_id", "id", "n_lines", "n_dropped"]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=key) == sorted(brute.deduped(docs), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df).collect() == []


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 16)
    rng = random.Random(2)
    docs = [(i, "\n".join(f"a line of its own, number {rng.random()} in a list" for _ in range(40)) + "\n" + lines(rng, 4)) for i in range(40)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == sorted(brute.deduped(docs))


def test_the_filter_is_held_once():
    """A task looks lines up in the filter that it is given, and makes no other of that size."""
    batch = pa.record_batch([pa.array([1]), pa.array(["a line of the corpus that is long enough to count"])], ["id", "text"])
    bits = np.full(2 ** (line_dedup.FILTER_BITS - 3), 255, np.uint8)
    given = SimpleNamespace(value=bits)
    tracemalloc.start()
    (found,) = line_dedup._suspects(iter([batch]), 40, line_dedup.FILTER_BITS, given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 1 and peak < bits.nbytes / 2
