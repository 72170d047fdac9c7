import random

from tidewatch.llm import syncmers

from . import brute


def compared(spark, docs, partitions=3):
    df = spark.createDataFrame([(t, i, 1, "k") for i, t in docs], "text string, doc_id long, bucket int, key string").repartition(partitions)
    return syncmers.compare_with_edited(df).collect()


def test_edited_texts_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(i * 3 - 20, " ".join(rng.choice(["wört", "a", "été", "日本", "plain", "Word"]) for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    docs += [(500, None), (501, "x" * 100_000), (502, "")]
    expected = {}
    for at, (i, text) in enumerate(docs):
        text, after = text or "", docs[(at + 1) % len(docs)][1] or ""
        half = len(text) // 2
        expected[i] = len(text), text[: len(text) - half] + after[:half]
    shuffled = docs[:]
    rng.shuffle(shuffled)
    out = compared(spark, shuffled)
    assert {r.id: (r.n_chars, r.edited_text) for r in out} == expected
    prints = {r.id: r.fingerprint for r in out}
    for r, (at, (i, _)) in zip(sorted(out, key=lambda r: r.id), enumerate(docs), strict=True):
        after = prints[docs[(at + 1) % len(docs)][0]]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == after:
            assert r.near_next == 1
    again = syncmers.fingerprints(spark.createDataFrame([(r.edited_text,) for r in out], "text string")).collect()
    assert sorted(r.fingerprint for r in again) == sorted(r.edited_fingerprint for r in out)


def test_anchors_need_no_context(spark):
    """Wherever a passage stands, the same k-mers of it are chosen; about two in four are."""
    rng = random.Random(5)
    passage = [f"w{rng.randrange(500)}" for _ in range(300)]
    docs = [(0, " ".join(passage)), (1, " ".join(["before"] * 7 + passage + ["after"] * 5))]
    rows = syncmers.anchors(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    own = {(r.place, r.hash) for r in rows if r.id == 0}
    moved = {(r.place - 7, r.hash) for r in rows if r.id == 1 and 7 <= r.place <= 7 + 300 - syncmers.K}
    assert own == moved
    assert 100 < len(own) < 220
    places = sorted(p for p, _ in own)
    assert max(b - a for a, b in zip(places, places[1:])) <= 3 * syncmers.K


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(7)
    a, b = (" ".join(f"{c}{rng.randrange(10_000)}" for _ in range(600)) for c in "ab")
    half = " ".join(a.split()[:300] + b.split()[:300])
    out = {r.id: r for r in compared(spark, [(1, a), (2, a), (3, half), (4, b)])}
    assert out[1].near_next == 1 and out[1].fingerprint == out[2].fingerprint
    assert 0.2 < out[2].near_next < 0.5
    assert out[4].near_next == 0


def test_nulls_repeats_and_nothing(spark):
    out = compared(spark, [(None, "a b"), (None, None), (4, "same text"), (4, "same text")])
    assert len(out) == 4 and len({r.fingerprint for r in out if r.id == 4}) == 1
    alone = compared(spark, [(1, "one row of its own here")])[0]
    assert alone.near_next == 1 and alone.n_chars == 23
    assert compared(spark, []) == []
    assert brute.words("A\x0bb") == ["a", "b"]


def test_texts_of_five_or_six_words_have_anchors(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + i % 2)) for i in range(40)]
    rows = syncmers.fingerprints(spark.createDataFrame([(t,) for t in [*texts, "", " \n"]], "text string")).collect()
    assert len({r.fingerprint for r in rows if r.text.strip()}) == 40
    assert {r.fingerprint for r in rows if not r.text.strip()} == {""}
    assert all(r.near_next == 0 for r in compared(spark, [*enumerate(texts), (99, "")]))
    found = syncmers.anchors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert found.select("id").distinct().count() == 40


def test_likeness_counts_all_anchors_of_long_texts(spark):
    rng = random.Random(8)
    a, b = (" ".join(f"{c}{rng.randrange(10**9)}" for _ in range(20_000)) for c in "ab")
    passage = " ".join(b.split()[7_000:7_060])
    rows = [(1, a), (2, a + " " + passage), (3, b)]
    found = syncmers._with_anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "found").collect()
    of = {r.doc_id: {x for x in r.found if x is not None} for r in found}
    out = {r.id: r for r in compared(spark, rows)}
    for i, j in [(1, 2), (2, 3), (3, 1)]:
        assert abs(out[i].near_next - len(of[i] & of[j]) / len(of[i] | of[j])) < 1e-4
    assert 0 < out[2].near_next < 0.01 and 0.99 < out[1].near_next < 1 and out[3].near_next == 0
    # The likeness can be worked out from the fingerprints alone.
    held = {i: {r.fingerprint[n : n + 8] for n in range(0, len(r.fingerprint), 8)} for i, r in out.items()}
    for i, j in [(1, 2), (2, 3), (3, 1)]:
        assert out[i].near_next == len(held[i] & held[j]) / len(held[i] | held[j])
