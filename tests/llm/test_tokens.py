import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import dac, packing, tokens
from tidewatch.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world", "", " \n", "it's O'Neil's 'tis don't we'll I'd", "a<|endoftext|>b <|startoftext|>", "12 3456 x9y", "café café Å İstanbul STRASSEß",
    "tab\tand\x0bvt\x0cff\x85nel\xa0nbsp em\x1cfs", "日本語 текст 🙂🙂 a🙂b", "x" * 3000, "!!! ??? '' '''s", "́ lone", "\x00nul ÷×ª",
]


def whole(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    for text, ids in zip(TEXTS, WordTokenizer(PATH).ids([t.encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_ids_equal_the_library_on_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    if not hasattr(test_ids_equal_the_library_on_any_text, "own"):
        test_ids_equal_the_library_on_any_text.own = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    own, library = test_ids_equal_the_library_on_any_text.own
    assert np.frombuffer(own.ids([text.encode()])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "again", "x", 1), (99, None, "x", 1), (50, "word " * 5000, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=2000))
def test_codes_round_trip(numbers):
    ids = np.array(numbers, np.uint32)
    levels, marks, ranks = dac.encode(ids)
    assert dac.decode(levels, marks).tolist() == numbers
    at = np.arange(len(ids))[::-1]
    assert dac.access(levels, marks, ranks, at).tolist() == numbers[::-1]


def test_written_tokens_are_read_back(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 100)
    dac.write_tokens(docs, f"file://{tmp_path}/t", PATH, end=1)
    got = [(r.id, r.start, r.n_tokens, bytes(r.tokens)) for r in dac.read_documents(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    by_text = sorted([*whole(r.text or ""), 1] for r in docs.collect())
    assert sorted(np.frombuffer(g[3], "<u4").tolist() for g in got) == by_text
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    stream = np.concatenate([np.frombuffer(g[3], "<u4") for g in got])
    asked = spark.createDataFrame([(i,) for i in [0, 5, 5, 99, 100, 101, 4999, len(stream) - 1, len(stream), -1, None]], "position long")
    found = {r.position: r.token for r in dac.tokens_at(spark, f"file://{tmp_path}/t", asked).collect()}
    assert found == {i: int(stream[i]) for i in [0, 5, 99, 100, 101, 4999, len(stream) - 1]}


def test_no_documents(spark, docs, tmp_path):
    dac.write_tokens(docs.limit(0), f"file://{tmp_path}/e", PATH)
    assert dac.read_documents(spark, f"file://{tmp_path}/e").collect() == []
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_packing_is_whole_and_tight(spark, docs):
    out = packing.pack(docs, PATH, capacity=64).collect()
    pieces = sorted(tuple(ids[i : i + 64]) for r in docs.collect() for ids in [[*whole(r.text or ""), 0]] for i in range(0, len(ids), 64))
    assert sorted(zlib.crc32(np.array(p, "<u4").tobytes()) for p in pieces) == sorted(r.crc for r in out)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) == -(-sum(r.length for r in out) // 64)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1), st.integers(40, 60))
def test_best_fit_equals_one_by_one(counts, capacity):
    bins: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(capacity)
                fit = len(bins) - 1
            bins[fit] -= length
    used: dict[int, int] = {}
    for length, rows in packing.best_fit(counts, capacity).items():
        ends = [r[0] for r in rows[1:]] + [counts[length]]
        for (first, sequence, each, offset), end in zip(rows, ends, strict=True):
            for rank in range(first, end):
                s, o = sequence + (rank - first) // each, offset + (rank - first) % each * length
                assert used.get(s, 0) == o
                used[s] = o + length
    assert sorted(capacity - u for u in used.values()) == sorted(bins)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé'ÿßÞ×·-.!~<|sStTreEmMlLdD09 \n\t\x1f\x7f\x85µ", max_size=40))
def test_pieces_equal_the_library(text):
    if not hasattr(test_pieces_equal_the_library, "own"):
        test_pieces_equal_the_library.own = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    own, library = test_pieces_equal_the_library.own
    assert own.cuts
    assert np.frombuffer(own.ids([text.encode()])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_not_cut_by_the_rule(tmp_path):
    import json

    settings_ = json.loads(Tokenizer.from_file(PATH).to_str())
    settings_["normalizer"] = None
    path = tmp_path / "t.json"
    path.write_text(json.dumps(settings_))
    assert not WordTokenizer(str(path)).cuts


def test_texts_come_in_slices_of_bounded_size():
    """A batch of many or long texts is worked on in parts, each row once and in order."""
    from tidewatch.llm import common

    documents = [None, "", "x" * common.SLICE_BYTES, "é" * common.SLICE_BYTES, *(["word " * 1000] * 1000), None]
    batch = pa.record_batch([pa.array(range(len(documents))), pa.array(documents)], ["id", "text"])
    got = list(common.texts(iter([batch, batch.slice(0, 0)]), "text"))
    assert len(got) > 4 and got[-1] == (batch.slice(0, 0), [])
    assert [k for rows, _ in got for k in rows.column("id").to_pylist()] == list(range(len(documents)))
    assert [t for _, part in got for t in part] == [(t or "").encode() for t in documents]
    assert all(sum(map(len, part[:-1])) <= common.SLICE_BYTES for _, part in got)


def test_pieces_are_encoded_as_the_library_does():
    tokenizer = WordTokenizer(PATH)
    texts = ["Don't ''s 12ab!? Ärger-ÿ x's'tail (#) é'll", "a" * 300, "'s 't '''re", "!'s?'", "½"]
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in tokenizer.ids([t.encode() for t in texts])] == want
    assert tokenizer.cuts


def test_a_word_is_cut_once_for_many_texts(monkeypatch):
    cut = []

    class Cutter:
        def findall(self, text, own=tokens._CUT):
            cut.append(text)
            return own.findall(text)

    monkeypatch.setattr(tokens, "_CUT", Cutter())
    texts = ["it's some, WORDS 12 été\x0b-- some,", "", " ", "\tsome words it's", "12 été"] * 200
    tokenizer = WordTokenizer(PATH)
    found = [np.frombuffer(x, "<u2").tolist() for x in tokenizer.ids([t.encode() for t in texts])]
    assert found == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(" ".join(cut).split()) == sorted(["it's", "some,", "words", "12", "été", "--", "some"])


def test_ids_are_whole_when_the_table_of_pieces_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "WORD_CACHE", 7)
    tokenizer = WordTokenizer(PATH)
    for texts in (["one two, three", "four"], ["five six", "two, one"], ["seven éé eight nine"], ["two one", "ten's eleven", "Čech"], ["four"]):
        found = [np.frombuffer(x, "<u2").tolist() for x in tokenizer.ids([t.encode() for t in texts])]
        assert found == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_are_encoded_some_at_a_time(monkeypatch):
    """What the library takes while it encodes does not grow with the new words of some texts."""
    monkeypatch.setattr(tokens, "PIECES", 50)
    words = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "klmnpqrst"]
    own, most = WordTokenizer(PATH), []

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, strings, **options):
            most.append(max(len(s.split()) for s in strings))
            return self.tokenizer.encode_batch_fast(strings, **options)

    own.plain = Watched(own.plain)
    text = " ".join(words)
    assert np.frombuffer(own.ids([text.encode()])[0], "<u2").tolist() == whole(text)
    assert len(most) > 4 and max(most) <= 50
