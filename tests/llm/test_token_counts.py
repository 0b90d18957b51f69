import pytest
import sentencepiece
from cases import ordered
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconloom.llm.common import tokenizer_path
from beaconloom.llm.token_counts import TokenCounter, count_tokens

FILE = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(FILE))


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(tokenizer_path(FILE), remembered=16_000)


def test_whole_tokens_are_one_token(counter, library):
    assert counter.splits and len(counter.whole) > 10_000
    assert all(len(library.encode(w.decode())) == 1 for w in list(counter.whole)[::37])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab\n\té▁the日<s>/\u0000  ", max_size=40))
def test_counts_are_the_librarys(counter, library, text):
    assert counter.count([text])[0] == len(library.encode(text))


def test_documents(odd, odd_rows, library):
    rows = ordered(count_tokens(odd, limit=1000), "n_bytes")
    expected = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd_rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == sorted(expected, key=str)
    assert all(r.over_limit == (r.n_tokens > 1000) for r in rows) and any(r.over_limit for r in rows)


def test_empty_table(empty):
    assert count_tokens(empty).collect() == []
