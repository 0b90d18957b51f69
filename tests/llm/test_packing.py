import zlib

import numpy as np
import pytest
from cases import frame, prose
from tokenizers import Tokenizer

from beaconloom.llm import packing
from beaconloom.llm.common import tokenizer_path
from beaconloom.llm.packing import ShardIndex, fill_windows


def test_weights_are_bm25():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint32) for _ in range(40)]
    idf = rng.random(50)
    index, mean = ShardIndex(rests, idf), np.mean([len(r) for r in rests])

    def weight(term, rest):
        times = int((rests[rest] == term).sum())
        norm = packing.K1 * (1 - packing.B + packing.B * len(rests[rest]) / mean)
        return idf[term] * times * (packing.K1 + 1) / (times + norm)

    for rest in range(40):
        best = sorted(set(rests[rest].tolist()), key=lambda t: (-weight(t, rest), t))[: packing.QUERY_TERMS]
        assert sorted(index.queries[rest].tolist()) == sorted(best)
        expected = [sum(weight(t, other) for t in best) for other in range(40)]
        assert np.allclose(index.scores(rest), expected)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(2)
    topics = [np.arange(1000 * k, 1000 * k + 30) for k in range(6)]
    rests = [rng.choice(topics[i % 6], 20).astype(np.uint32) for i in range(60)]
    windows = fill_windows(rests, np.ones(6000), 100)
    alike = [len({r % 6 for r, _, _ in w}) for w in windows]
    assert len(windows) == 12 and np.mean([a == 1 for a in alike]) > 0.7


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_full_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    rests = [rng.integers(0, 400, rng.integers(1, 64)).astype(np.uint32) for _ in range(rng.integers(0, 90))]
    windows = fill_windows(rests, rng.random(400), 64)
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert all(s == 64 for s in sizes[:-1]) and all(0 < s <= 64 for s in sizes[-1:])
    seen = sorted(p for w in windows for p in w)
    at = {}
    for rest, start, length in seen:
        assert start == at.get(rest, 0) and length > 0
        at[rest] = start + length
    assert at == {i: len(r) for i, r in enumerate(rests)}


def check(rows, found, window):
    library = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    texts = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    assert sum(r.length for r in found) == sum(map(len, texts))
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id, own in pieces.items():
        ids = [x for (i, _), x in zip(rows, texts, strict=True) if i == doc_id]
        expected_total = sum(map(len, ids))
        assert sum(n for _, n, _, _ in own) == expected_total and {t for *_, t in own} == {len(x) for x in ids}
        assert all(zlib.crc32(ids[0][a : a + n]) == crc for a, n, crc, _ in own)
        if len(ids) == 1:
            assert [a for a, *_ in sorted(own)] == np.cumsum([0, *[n for _, n, *_ in sorted(own)]])[:-1].tolist()
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= window
    return len(places) * window - sum(map(len, texts))


def test_documents(odd, odd_rows):
    assert check(odd_rows, packing.pack(odd).collect(), 2048) < 2048


def test_several_shards(lake, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_RESTS", 30)
    rows = [(i, prose(i, i % 70)) for i in range(120)]
    assert check(rows, packing.pack(frame(lake, rows).repartition(3), window=128).collect(), 128) < 4 * 128


def test_document_frequencies_cover_the_corpus(lake):
    rows = [(i, prose(i, 30)) for i in range(50)]
    encoded = frame(lake, rows).repartition(4).mapInArrow(packing._encode(packing.VOCABULARY, 1, 64), packing._ENCODED).cache()
    found = packing._frequencies(encoded)
    library = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    expected = np.zeros(len(found) - 1, int)
    for _, t in rows:
        expected[sorted({*library.encode(t, add_special_tokens=False).ids, 1})] += 1
    assert found[-1] == 50 and found[:-1].tolist() == expected.tolist()


def test_empty_table(empty):
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("topics", [16, 32])
def test_like_documents_share_a_shard_at_any_size(lake, monkeypatch, topics):
    monkeypatch.setattr(packing, "SHARD_RESTS", 40)
    rng, rows = np.random.default_rng(topics), []
    letters = list("bcdfghklmnprstvz")
    words = [[" ".join(rng.choice(letters, 5)) for _ in range(12)] for _ in range(topics)]
    for i in range(40 * topics):
        rows.append((i, " ".join(rng.choice(words[i % topics], 8)).replace(" ", "a") + f" {i}"))
    found = packing.pack(frame(lake, rows).repartition(3), window=256).collect()
    shard = {r.doc_id: r.sequence_id >> 33 for r in found}
    assert set(np.bincount(list(shard.values())) <= 80) == {True} and len(set(shard.values())) > topics / 2
    alike = np.mean([shard[a] == shard[a + topics] for a in range(39 * topics)])
    assert alike > 0.2  # by chance it is one in as many as there are shards


def test_copies_fill_several_shards(lake, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_RESTS", 30)
    rows = [(i, prose(1, 40)) for i in range(200)] + [(200 + i, prose(i, 40)) for i in range(40)]
    found = packing.pack(frame(lake, rows).repartition(3), window=128).collect()
    check(rows, found, 128)
    assert np.bincount([s >> 33 for s in {r.doc_id: r.sequence_id for r in found}.values()]).max() < 75
