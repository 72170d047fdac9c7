import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import near_dedup
from tidewatch.llm.graph import components

from . import brute


def rows(spark, docs, k=4, percent=80):
    df = spark.createDataFrame(docs, "doc_id long, text string, id string, digest int, n int, component string")
    return {r.id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(df, k=k, percent=percent).collect()}


def noise(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(300)) for _ in range(n)]


def test_groups_equal_brute_force(spark):
    rng, docs = random.Random(5), {}
    for g in range(12):
        base = noise(rng, rng.choice([3, 6, 9, 40, 200]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = [w if rng.random() > 0.03 else noise(rng, 1)[0] for w in base]
            docs[len(docs)] = " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)
    docs |= {900: None, 901: "", 902: " \n\t ", 903: "one", 904: "one", 905: "One two", 906: "one\ntwo", 907: "x" * 50_000}
    expected = brute.near(docs, 4, 80)
    assert rows(spark, [(i, t, "a", 1, 2, "b") for i, t in docs.items()]) == expected


def test_nulls_repeats_and_nothing(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " x"), (None, None)], "doc_id long, text string")
    out = sorted(((r.id, r.component, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_chain_within_one_bucket(spark):
    """Each text is near the next one only: the smallest id is reached over many links."""
    base = [f"w{i}" for i in range(120)]
    docs = {i: " ".join(base[i * 4 : i * 4 + 60]) for i in range(15)}
    assert rows(spark, [(i, t, "a", 1, 2, "b") for i, t in docs.items()]) == brute.near(docs, 4, 80)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        found = []
        for _ in range(40):
            common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            a, b = (np.unique(np.append(common, rng.integers(0, 2**63, 1000 - len(common), dtype=np.uint64))) for _ in range(2))
            found.append(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)))
        truth = 1000 * share / (2000 - 1000 * share)
        assert abs(np.mean(found) - truth) < 0.03


def test_small_sets_agree_as_often_as_similar():
    rng = np.random.default_rng(4)
    found = []
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, 5, dtype=np.uint64))
        found.append(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(a[:4])))
    assert abs(np.mean(found) - 0.8) < 0.03


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.integers(1, 5))
def test_shingles_equal_brute_force(numbers, k):
    hashes = near_dedup.WordHashes().of([str(n).encode() for n in numbers])
    assert len(near_dedup.shingle_set(hashes, k)) == len(brute.shingles(" ".join(map(str, numbers)), k))


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).selectExpr("id a", "id - 1 b")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(1, 200)}
    assert components(links.limit(0)).collect() == []


def test_prefix_filter_loses_no_pair(spark, tmp_path):
    """All pairs of a set of groups, at and around the wished similarity; sizes differ, some rows are repeated."""
    rng, docs = random.Random(11), {}
    for g in range(6):
        base = [f"{g}w{i}" for i in range(rng.choice([8, 30, 80]))]
        for _ in range(30):
            kept = base[: rng.randrange(len(base) * 7 // 10, len(base) + 1)] if rng.random() < 0.5 else base
            docs[len(docs)] = " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(40)}" for w in kept)
    truth = set()
    sets = {i: brute.shingles(t, 4) for i, t in docs.items()}
    for a in docs:
        for b in docs:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] != sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                truth.add((a, b))
    frame = spark.createDataFrame([*docs.items(), (3, docs[3])], "id long, text string").repartition(4)
    # One bucket that holds everything, each document a component of its own.
    apart = spark.createDataFrame([(1, i, i) for i in docs], "band long, id long, component long")
    found = {tuple(r) for r in near_dedup._by_prefix(apart, frame, 4, 80, near_dedup.Scratch(spark)).collect()}
    assert truth <= found and len(truth) > 100
    assert len(found) < len(docs) * (len(docs) - 1) / 2 / 3


def test_copies_of_a_missing_original(spark):
    """Many copies, each edited too much to be near any other: no pair is near, and few are even looked at."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    docs = {i: " ".join(w if rng.random() > 0.03 else f"x{rng.random()}" for w in base) for i in range(150)}
    expected = brute.near(docs, 4, 80)
    assert rows(spark, [(i, t, "a", 1, 2, "b") for i, t in docs.items()]) == expected
