import zlib

import numpy as np
import pytest
from cases import frame, key, ordered, prose
from tokenizers import Tokenizer

from beaconloom.llm import token_files
from beaconloom.llm.common import tokenizer_path
from beaconloom.llm.token_files import WaveletShard, pack_shard
from beaconloom.llm.word_ids import WordIds, with_end
from beaconloom.session import scratch_path

FILE = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(FILE))


def test_ids_are_the_librarys(library, odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["\x1c\x1da\x85b", "İstanbul ΑΣ ΣΑΣ", "don't 'S <|startoftext|>x", "ẹ́ ́ á"]
    for remembered in (1 << 20, 8):  # also with next to no memory
        own = WordIds(tokenizer_path(FILE), remembered)
        for _ in range(2):
            ids, first = own.encode(texts)
            expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, first[1:-1])] == expected
    assert own.encode([])[0].tolist() == []


def test_whole_texts_where_words_do_not_split(library):
    own = WordIds(tokenizer_path("byte_bpe_50k.json"))
    assert not own.splits
    other = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids, _ = own.encode(["a  b\n c"])
    assert ids.tolist() == other.encode("a  b\n c", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [0, 1, 63, 511, 512, 513, 3000])
def test_shard_answers(size):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.3, size) % 49_408).astype(np.uint32)
    shard = WaveletShard(pack_shard(ids))
    assert len(shard) == size and (shard.ids == ids).all()
    for at in range(0, size, max(1, size // 50)):
        assert shard.access(at) == ids[at]
    for token in {*ids[:12].tolist(), 0, 49_407, 1 << 20}:
        places = np.flatnonzero(ids == token).tolist()
        assert shard.count(token) == len(places) and shard.occurrences(token) == places
        assert shard.rank(token, size // 2) == int((ids[: size // 2] == token).sum())
    with pytest.raises(IndexError):
        shard.access(size)
    with pytest.raises(IndexError):
        shard.select(7, shard.count(7))


def test_large_ids_and_foreign_files():
    ids = np.array([70_000, 3, 70_000, 1 << 20], np.uint32)
    assert WaveletShard(pack_shard(ids)).ids.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        WaveletShard(b"nonsense" * 9)


def written(lake, docs, shard_ids=1 << 19):
    path = scratch_path(lake, "token-files")
    token_files.write_token_files(docs, path, FILE, 2, shard_ids)
    return token_files.read_token_files(lake, path)


@pytest.mark.parametrize("shard_ids", [1, 100, 1 << 19])
def test_files_read_back(lake, odd, odd_rows, library, shard_ids):
    rows = token_files.document_digests(written(lake, odd, shard_ids)).orderBy("start").collect()
    start, texts = 0, dict()
    for i, t in odd_rows:
        texts.setdefault(i, set()).add(t or "")
    assert [r.doc_id for r in rows] == [i for i, _ in sorted(odd_rows, key=key)]
    for r in rows:
        (text,) = texts[r.doc_id]
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_many_blocks_and_occurrences(lake, library, monkeypatch):
    from beaconloom.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 700)
    rows = [(i * 13 % 97, prose(i, i % 50)) for i in range(97)]
    shards = written(lake, frame(lake, rows).repartition(4), 64).cache()
    ids = np.concatenate([[*library.encode(t, add_special_tokens=False).ids, 2] for _, t in sorted(rows)])
    digests = ordered(token_files.document_digests(shards))
    assert [r.doc_id for r in digests] == list(range(97))
    assert sum(r.n_tokens for r in digests) == len(ids)
    for token in (2, int(ids[0]), 48_000):
        assert sorted(r.place for r in token_files.occurrences(shards, token).collect()) == np.flatnonzero(ids == token).tolist()


def test_empty_table(lake, empty):
    assert token_files.document_digests(written(lake, empty)).collect() == []


def test_end_ids():
    ids, first = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 2)
    assert ids.tolist() == [5, 6, 2, 2, 7, 2] and first.tolist() == [0, 3, 4, 6]
