import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import contracts, whitening


def model(rows, components=32):
    """Whitening of (id, vector) rows in plain numpy, one row after the other; id -> (deviation, |whitened|), shares."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    centred = np.array([[float(c - Fraction(s, n)) for c, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [(i, d, w) for (i, _), d, w in zip(good, deviation, white)], values[order] / values.sum(), n


def table(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    floats = lambda v: v and [c if c is None else float(c) for c in v]
    df = spark.createDataFrame([(i, floats(v), 7, 0.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")
    df.repartition(5).write.parquet(path)


def test_equals_plain_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [1, 3, 0.5, 2, 0.1, 5]]) for i in range(300)]
    # A third of all rows are one vector; some rows are repeated as a whole.
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[5], rows[5]]
    bad = [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [float("nan")] * 6), (2003, [float("inf"), 0, 0, 0, 0, 0]), (2004, [1.0, 2.0]), (2005, [])]
    table(spark, rows + bad + [(None, rows[7][1])], tmp_path)
    out = contracts.op12_whitening(spark, str(tmp_path)).collect()
    wanted, shares, n = model(rows + [(None, rows[7][1])])
    assert {r.n for r in out} == {n} and len(out) == 6 * n
    assert {r.component for r in out} == set(range(1, 7))
    assert max(r.identity_error for r in out) < 1e-9
    found = {}
    for r in out:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
    signs = {}
    for i, deviation, white in wanted:
        assert (i, deviation) in found
        for c, w in enumerate(white, 1):
            got = found[i, deviation][c]
            assert len(set(got)) == 1
            assert abs(got[0]) == pytest.approx(abs(w), rel=1e-8, abs=1e-10)
            if abs(w) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(got[0] * w))
    assert all(len(s) == 1 for s in signs.values())
    assert sum(len(v) for f in found.values() for v in f.values()) == len(out)


def test_weights_of_one(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0])], "id long, v array<double>")
    out = whitening.whiten(df, "id", "v", weighted=False).collect()
    assert {r.n for r in out} == {4} and len(out) == 10
    by_id = {r.id: r.whitened for r in out if r.component == 1}
    assert by_id[1] == by_id[2] and sum(by_id[i] for i in (1, 3, 4, 5)) == pytest.approx(0)


@pytest.mark.parametrize("rows", [[(1, [0.25, 1.0])], [(1, [0.25, 1.0]), (2, [0.25, 1.0])]])
def test_no_variance(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 2 * len(rows)
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in out} == {(0.0, 0.0, 0.0, 0)}


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, -1e300]), (3, [1.0, 2.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 6 and all(math.isfinite(r.whitened) for r in out)
    assert {r.deviation for r in out} == {None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_usable(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_packing_is_exact():
    rows = np.array([[0, -5], [2**15, 3], [2**40, -(2**53)], [32767, -32767], [-32768, 0]], np.int64)
    assert (whitening.unpack(whitening.pack(rows), 2) == rows).all()
    assert len(set(whitening.pack(rows))) == 5
