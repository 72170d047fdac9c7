import random

from tidewatch.llm import decontaminate

from . import brute


def plain(text):
    return b" ".join(decontaminate.tokens_of((text or "").encode())).decode()


def truth(docs, items):
    """(document, item) -> edits, by the plain dynamic program on whole texts."""
    out = {}
    for i, text in docs.items():
        for j, item in items.items():
            if own := plain(item):
                edits = brute.edit_distance_within(own, plain(text))
                if edits <= int(decontaminate.MAX_EDITS * len(own)):
                    out[i, j] = edits
    return out


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else [w[:-1] + "q"] if x < share else [w]
    return out


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_finds_edited_items_and_nothing_else(spark):
    rng = random.Random(6)
    items = {j: " ".join(words(rng, rng.randrange(8, 40))) + "." for j in range(12)} | {50: None, 51: "", 52: "?!"}
    docs = {}
    for i in range(90):
        around = [words(rng, rng.randrange(0, 40)) for _ in range(2)]
        held = edited(rng, items[i % 12].split(), rng.choice([0, 0, 0.05, 0.1])) if i % 3 else []
        text = " ".join([*around[0], *held, *around[1]])
        docs[i] = text.upper() if i % 7 == 0 else text.replace(" ", "\n ") if i % 5 == 0 else text
    docs |= {200: None, 201: "", 202: "... !!"}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, items string, item_id int").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = truth(docs, items)
    for block_chars in (decontaminate.BLOCK_CHARS, 300):
        out = decontaminate.find_items(df, bench, block_chars=block_chars)
        assert out.columns == ["doc_id", "text", "item_id", "items"]
        found = {(r.doc_id, x.item_id): x.edits for r in out.collect() for x in r["items"]}
        assert found.keys() <= expected.keys()
        assert len(found) >= 0.95 * len(expected) > 40
        assert sum(found[k] == expected[k] for k in found) >= 0.95 * len(found)


def test_distance_equals_the_plain_program():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert decontaminate.distance_within(a, b)[0] == brute.edit_distance_within(a, b)


def test_distances_in_lanes_equal_single_ones():
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abé 😀") for _ in range(n)), "".join(rng.choice("abéx ") for _ in range(rng.randrange(0, 3 * n)))) for n in (1, 63, 64, 65, 128, 200) for _ in range(60)]
    pairs += [(a, a[:9] + b + a[3:]) for a, b in pairs[::7]]
    assert decontaminate.distances_within(pairs) == [decontaminate.distance_within(a, b)[0] for a, b in pairs]
    assert decontaminate.distances_within([]) == []


def test_nulls_repeats_and_nothing(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "zero " * 30_000 + text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (4, text), (4, text)], "item_id long, text string")
    rows = decontaminate.find_items(docs, bench).collect()
    assert sorted((str(r.doc_id), [(x.item_id, x.edits) for x in r["items"]]) for r in rows) == [("1", [(4, 0), (None, 0)]), ("1", [(4, 0), (None, 0)]), ("2", []), ("None", [(4, 0), (None, 0)])]
    assert decontaminate.find_items(docs.limit(0), bench).collect() == []
    assert all(r["items"] == [] for r in decontaminate.find_items(docs, bench.limit(0)).collect())


def typos(rng, text, share):
    """text with that share of its characters replaced, removed or doubled, at random places."""
    out = list(text)
    for at in rng.sample(range(len(text)), int(share * len(text))):
        out[at] = rng.choice(["", "z" + out[at], rng.choice("wxyz")])
    return "".join(out)


def test_finds_edits_at_any_place_up_to_the_limit(spark):
    rng = random.Random(11)
    items = {j: " ".join(words(rng, n)) for j, n in enumerate([2, 3, 5, 8, 15, 15, 25, 38, 38, 60])}
    docs, kinds = {}, {}
    for kind in (0.04, 0.08, 0.12, 0.16, 0.19, "words"):
        for j, item in items.items():
            for _ in range(4):
                held = " ".join(w[:-1] + "z" for w in item.split()) if kind == "words" else typos(rng, item, kind)
                docs[len(docs)] = " ".join([*words(rng, rng.randrange(0, 60)), held, *words(rng, rng.randrange(0, 60))])
                kinds[len(kinds)] = kind, j
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, x.item_id): x.edits for r in decontaminate.find_items(df, bench).collect() for x in r["items"]}
    expected = {}
    for i, text in docs.items():
        for j, item in items.items():
            edits = decontaminate.distance_within(plain(item), plain(text))[0]
            if edits <= int(decontaminate.MAX_EDITS * len(plain(item))):
                expected[i, j] = edits
    assert found.items() <= expected.items()
    for kind in {k for k, _ in kinds.values()}:
        of = [p for p in expected if kinds[p[0]] == (kind, p[1])]
        assert sum(p in found for p in of) >= 0.98 * len(of) and (kind == "words" or len(of) > 20)
    short = [p for p in expected if len(items[p[1]]) < 60]
    assert short and all(p in found for p in short)


def test_what_is_asked_of_short_items_no_edits_can_take():
    for n in range(1, 56):
        gram, hits = decontaminate.asked(n, n // 5)
        assert 1 <= hits <= n - gram + 1 - gram * (n // 5)


def test_a_long_text_is_searched_across_its_pieces(monkeypatch):
    rng = random.Random(3)
    item = " ".join(words(rng, 30))
    held = typos(rng, item, 0.15)
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    block = decontaminate.Items.of([(5, item.encode()), (6, b"q" * 30)])
    for before in range(0, 2000, 97):
        text = " ".join(words(rng, 500))[:before] + " " + held + " " + "q" * 300
        found = block.confirmed(["", text], block.candidates(["", text]), 0.2)
        assert found[1].keys() == {5, 6} and not found.get(0)


def test_normal_text_is_its_tokens_joined():
    rng = random.Random(8)
    alphabet = ["a", "B", "é", " ", "-", "'", ".", "?", " ", "\n", "\t", "\x0b", "\x1c", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))).encode()
        assert decontaminate.normal(text) == b" ".join(decontaminate.tokens_of(text))
    assert decontaminate.normal(b"a" + b"-" * 300_000 + b"b") == b"a" + b"-" * 300_000 + b"b"  # in linear time


def test_whole_distances_are_found_for_near_pairs_only():
    rng = random.Random(9)
    pairs, near = [], set()
    for n in (3, 9, 20, 40, 60):
        for _ in range(30):
            item, around = " ".join(words(rng, n)), words(rng, n)
            held = typos(rng, item, rng.choice([0.02, 0.1, 0.19]))
            pairs += [(item, " ".join(around)), (item, " ".join([*around[: n // 2], held, *around[n // 2 :]])), (item, held), (item, "")]
    for pair in pairs:
        if decontaminate.distance_within(*pair)[0] <= int(0.2 * len(pair[0])):
            near.add(pair)
    left = decontaminate.possible(pairs, 0.2)
    assert near <= set(left) and len(near) > 200
    assert all(pair in near for pair in left if len(pair[0]) > 64)


def test_texts_are_normalised_together_as_alone():
    rng = random.Random(12)
    alphabet = ["a", "B", "é", "😀", " ", "-", "'", ".", "?", " ", "\n", "\t", "\x0b", "\x1c", "\x85"]
    for n in (0, 1, 2, 700):
        some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))).encode() for _ in range(n)]
        assert decontaminate.normals(some) == [b" ".join(decontaminate.tokens_of(text)) for text in some]


def test_pairs_and_bands_are_not_worked_on_one_by_one(monkeypatch):
    rng = random.Random(13)
    searches = []
    search = decontaminate.np.searchsorted
    monkeypatch.setattr(decontaminate.np, "searchsorted", lambda *args, **more: searches.append(1) or search(*args, **more))
    pairs = [(" ".join(words(rng, 6)), " ".join(words(rng, 20))) for _ in range(400)]
    assert decontaminate.distances_within(pairs) == [decontaminate.distance_within(a, b)[0] for a, b in pairs]
    items = [" ".join(words(rng, 20)) for _ in range(40)]
    texts = [typos(rng, rng.choice(items), 0.1) for _ in range(400)]
    block = decontaminate.Items.of([(j, item.encode()) for j, item in enumerate(items)])
    found = block.confirmed(texts, block.candidates(texts), 0.2)
    assert sum(map(bool, found.values())) == len(texts)
    assert len(searches) < 100


def test_lanes_of_large_alphabets_equal_single_ones(monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(decontaminate, "CELLS", 3000)
    pairs = [("".join(chr(rng.randrange(0x4E00, 0x4E80)) for _ in range(n)), "".join(chr(rng.randrange(0x4DF0, 0x4E90)) for _ in range(rng.randrange(0, 2 * n)))) for n in (5, 64, 70) for _ in range(80)]
    pairs += [(a, b[:5] + a[3:] + b) for a, b in pairs[::5]]
    assert decontaminate.distances_within(pairs) == [decontaminate.distance_within(a, b)[0] for a, b in pairs]
