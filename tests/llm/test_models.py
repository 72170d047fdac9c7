import math
import random

import numpy as np
import pytest

from tidewatch.llm import brown, quality

from . import brute


@pytest.fixture(scope="module")
def corpus():
    """Two languages whose words never meet, with rare words of their own."""
    rng = random.Random(1)
    pools = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    # Every tenth text is held out: they take turns between the languages too.
    of = [i // 2 % 2 for i in range(300)]
    return [(i, " ".join(rng.choice(pools[of[i]]) if rng.random() < 0.8 else f"{'ab'[of[i]]}rare{rng.randrange(400)}" for _ in range(rng.randrange(5, 80)))) for i in range(300)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return brown.fit(spark.createDataFrame(corpus, "doc_id long, text string").where("doc_id % 10 <> 0"))


def test_base_and_counts_equal_brute_force(spark, corpus, model):
    docs = [*corpus, (900, None), (901, ""), (902, "A1 a1 never-seen"), (None, "a1"), (3, corpus[3][1])]
    counts = brute.unigrams([t for i, t in corpus if i % 10])
    n, v = sum(counts.values()), len(counts)
    assert (model.total, model.distinct) == (n, v)
    expected = []
    for i, text in docs:
        tokens = [*brute.words(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        expected.append((i is None, i or 0, len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 6)))
    for frequent in (brown.FREQUENT, 50):
        df = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, n int").repartition(5)
        out = brown.score(df, model, frequent=frequent).collect()
        assert sorted((r.id is None, r.id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == sorted(expected)


def test_scores_do_not_depend_on_what_is_broadcast(spark, corpus, model):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    few, all_ = ({r.id: r.score for r in brown.score(df, model, frequent=n).collect()} for n in (20, brown.FREQUENT))
    assert few.keys() == all_.keys() and all(math.isclose(few[k], all_[k], rel_tol=1e-9) for k in few)


def test_probabilities_sum_to_one(model):
    words = model.words.collect()
    n, group = (np.array([r[c] for r in words]) for c in ("n", "class"))
    for history in {*model.classes.tolist()}:
        known = model.chance(np.full(len(n), history), n, group).sum()
        unknown = model.chance(np.array([history]), np.array([0]), np.array([0]))[0]
        assert math.isclose(known + unknown, 1, rel_tol=1e-9)


def test_classes_beat_the_base_on_held_out_text_and_order_matters(spark, corpus, model):
    held = [(i, t) for i, t in corpus if i % 10 == 0]
    rng = random.Random(4)
    mixed = [(i, " ".join(rng.sample([w for _, t in held for w in t.split()], len(t.split())))) for i, t in held]
    own, other = (brown.score(spark.createDataFrame(x, "doc_id long, text string"), model).selectExpr("sum(score) s", "sum(base_score) b").first() for x in (held, mixed))
    assert own.s > own.b + 100
    assert own.s > other.s + 100


def test_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = brown.fit(empty)
    assert brown.score(empty, nothing).collect() == []
    row = brown.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing).first()
    assert (row.n_tokens, row.n_known) == (3, 0) and row.score <= 0


def test_isotonic_equals_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = rng.integers(1, 9)
        scores, labels, weights = np.sort(rng.normal(size=n)), rng.random(n), rng.integers(1, 5, n).astype(float)
        got = quality.isotonic(scores, labels, weights)
        low = [max(min(np.average(labels[a : b + 1], weights=weights[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, low)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.fit(docs, labels.where("doc_id % 4 <> 2"))
    rows = quality.score(docs, fitted).join(labels.where("doc_id % 4 = 2"), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in rows]) > 0.95


def test_quality_of_nulls_and_nothing(spark):
    schema = "doc_id long, text string, score string, label int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "a text. " * 50_000, "x", 1), (4, "!!! A%%% B###", None, 2), (4, "!!! A%%% B###", None, 2)], schema)
    labels = spark.createDataFrame([(4, 0), (1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        out = quality.score(docs, quality.fit(docs, known)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []
