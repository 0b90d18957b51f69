import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, prose

from beaconloom.llm import ngram_scores
from beaconloom.llm.ngram_scores import BACKOFF, packed, score_documents, steps, unpacked


def reference(rows, order=3):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    grams = [[Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, order + 1)] for _, w in texts]
    totals = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    words, out = sum(len(w) for _, w in texts), []
    for (doc_id, text), own in zip(texts, grams, strict=True):
        def other(gram, own=own):
            return totals[len(gram) - 1][gram] - own[len(gram) - 1][gram]

        total = 0.0
        for k in range(len(text)):
            score, n = None, min(order, k + 1)
            factor = 1.0
            while n > 1 and score is None:
                gram = tuple(text[k - n + 1 : k + 1])
                if other(gram) > 0:
                    score = factor * other(gram) / other(gram[:-1])
                factor *= BACKOFF
                n -= 1
            if score is None:
                score = factor * max(other((text[k],)), 0.5) / max(words - len(text), 1)
            total += math.log(score)
        out.append((doc_id, len(text), total))
    return out


def same(found, expected):
    found = sorted(((r.doc_id, r.n_words, r.log_score) for r in found), key=str)
    expected = sorted(expected, key=str)
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert np.allclose([f[2] for f in found], [e[2] for e in expected], atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_counters(lake, monkeypatch, order):
    monkeypatch.setattr(ngram_scores, "BATCH_BYTES", 900)
    rows = [(i, prose(i % 23, i % 40)) for i in range(60)]
    same(score_documents(frame(lake, rows).repartition(3), order).collect(), reference(rows, order))


def test_odd_rows(odd, odd_rows):
    same(score_documents(odd).collect(), reference(odd_rows))


def test_one_document_and_none(lake, empty):
    same(score_documents(frame(lake, [(1, "a b a b")])).collect(), reference([(1, "a b a b")]))
    assert score_documents(empty).collect() == []
    same(score_documents(frame(lake, [(1, None)])).collect(), [(1, 0, 0.0)])


def test_packed_numbers():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (np.cumsum(unpacked(packed(steps(values)), np.uint64, 1000)) == values).all()
    assert len(unpacked(packed(values[:0]), np.uint64, 0)) == 0


def test_shared_hashes_leave_scores_finite(lake, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(30)]
    monkeypatch.setattr(ngram_scores, "HASH_BITS", 12)
    monkeypatch.setattr(ngram_scores, "BATCH_BYTES", 4000)
    for order in (2, 3):
        found = score_documents(frame(lake, rows), order).collect()
        assert len(found) == 30 and all(math.isfinite(r.log_score) for r in found)


def test_a_context_without_a_count_is_backed_off():
    grams = ngram_scores.Grams(pa.array(["a b c"]), 3)
    counts = [(np.unique(grams.of(n)[1]), np.full(4 - n, own)) for n, own in ((1, 3), (2, 1), (3, 5))]
    scores = ngram_scores.word_scores(grams, counts, 100)
    assert np.isfinite(scores).all() and np.isclose(scores[2], math.log(BACKOFF * BACKOFF * 2 / 97))


def test_hashes_are_whole():
    """By 56 bits, one n-gram in six million would share its hash at 30 GB."""
    assert ngram_scores.HASH_BITS == 64
