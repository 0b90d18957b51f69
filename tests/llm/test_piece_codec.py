import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconloom.llm import piece_codec
from beaconloom.llm.common import tokenizer_path
from beaconloom.llm.piece_codec import PieceCodec


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(tokenizer_path(piece_codec.MODEL))


TEXTS = st.text(alphabet=" abtheing\n\té日<s>/\u0000 ", max_size=40)


def keys(n):
    return np.arange(n, dtype=np.uint64)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_without_dropout_it_is_the_librarys(codec, text):
    assert codec.encode([text], keys(1), 0.0, 1)[0].tolist() == codec.library.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" ab▁the\n日\u0000é", max_size=30), max_size=4), st.sampled_from([0.1, 0.5, 1.0]))
def test_any_segmentation_decodes(codec, texts, chance):
    ids, first = codec.encode(texts, keys(len(texts)), chance, 3)
    assert [t.decode() for t in codec.decode(ids, first)] == texts


def drawn(codec, word, key, chance):
    """Ids of one occurrence, its lots drawn number by number."""
    limit = min(int(chance * (1 << 64)), piece_codec._M64)
    lots = [piece_codec._mix(key + (k + 1) * piece_codec._STEP & piece_codec._M64) < limit for k in range(3 * len(word))]
    return codec.segment(word, lots)[0]


def test_every_occurrence_draws_its_own_lots(codec):
    text = "the meadow, saddled thunderously; éé 日本語 " + "x" * 100 + " a▁b counterrevolutionary  internationally the meadow " + "ab" * 25
    words = [w.decode() for w in re.findall(rb" +[^ ]*", b" " + " ".join([text] * 30).encode())]
    base = piece_codec._mix(5)
    for chance in (0.0, 0.2, 0.7, 1.0):
        ids, _ = codec.encode([" ".join([text] * 30)], np.array([9], np.uint64), chance, 5)
        own = [piece_codec._mix(place + piece_codec._mix(9 ^ base) & piece_codec._M64) for place in range(len(words))]
        assert ids.tolist() == [i for w, k in zip(words, own, strict=True) for i in drawn(codec, w, k, chance)]


def test_the_cuts_of_a_word_grow_with_its_occurrences(codec):
    for word, least in (("internationally", 60), ("counterrevolutionary", 100)):
        ids, first = codec.encode([word] * 4000, keys(4000), 0.1, 1)
        assert len({tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)}) > least


def test_seeds_and_places_vary_and_repeat(codec):
    text = "internationally counterrevolutionary " * 40
    a, _ = codec.encode([text], keys(1), 0.3, 1)
    assert codec.encode([text], keys(1), 0.3, 1)[0].tolist() == a.tolist()
    assert PieceCodec(tokenizer_path(piece_codec.MODEL)).encode(["x", text], keys(2)[::-1].copy(), 0.3, 1)[0].tolist()[-len(a) :] == a.tolist()
    assert codec.encode([text], keys(1), 0.3, 2)[0].tolist() != a.tolist()
    assert codec.encode([text], keys(2)[1:], 0.3, 1)[0].tolist() != a.tolist()
    plain = codec.encode([text], keys(1), 0.0, 1)[0]
    every = codec.encode([text], keys(1), 1.0, 1)[0]
    assert len(plain) < len(a) < len(every) and all(len(codec.library.id_to_piece(int(i))) == 1 for i in every)


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 4)
    texts = ["one two three four five six", "seven eight"] * 3
    for _ in range(3):
        ids, first = codec.encode(texts, keys(6), 0.2, 1)
        assert [t.decode() for t in codec.decode(ids, first)] == texts


def test_documents(odd, odd_rows):
    rows = piece_codec.decode(piece_codec.encode(odd)).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(i), t or "") for i, t in odd_rows)
    assert {len(r.ids) for r in rows if r.doc_id in (1, 2)} == {0}
    twice = [r.ids for r in rows if r.doc_id == 6]
    assert twice[0] == twice[1]


def test_empty_table_and_null_ids(lake, empty):
    assert piece_codec.decode(piece_codec.encode(empty)).collect() == []
    df = lake.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in piece_codec.decode(df).collect()) == [(1, None), (2, "")]


def test_round_trip(odd, odd_rows):
    rows = piece_codec.round_trip(odd).collect()
    expected = [(str(i), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.sha256) for r in rows) == sorted(expected)
    ids = {(r.doc_id, r.sha256): r.ids for r in rows}
    assert all(ids[r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()] == r.ids for r in piece_codec.decode(piece_codec.encode(odd)).collect())
