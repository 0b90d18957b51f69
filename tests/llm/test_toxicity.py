import math
import random

import numpy as np
import pytest
from cases import WORDS, frame, prose
from pyspark.sql import functions as F

from beaconloom.llm import toxicity
from beaconloom.llm.common import held_out

FOUL = ["vilewort", "grubscum", "dunghead", "rotfiend"]


def maximal_by_definition(scores):
    """The best segment, then the same to its left and right; of equal ones the shortest, and the first."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            value = sum(scores[a:b])
            if value > 0 and (best is None or (value, a - b) > (best[2], best[0] - best[1])):
                best = (a, b, value)
    if best is None:
        return []
    left = maximal_by_definition(scores[: best[0]])
    right = [(a + best[1], b + best[1], s) for a, b, s in maximal_by_definition(scores[best[1] :])]
    return [*left, best, *right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        found = toxicity.maximal_segments(np.array(scores))
        expected = maximal_by_definition(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert all(math.isclose(x[2], y[2]) for x, y in zip(found, expected, strict=True))


def test_rate_solves_its_equation():
    values, weights = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    rate = toxicity.solve_rate(values, weights)
    assert abs((weights * np.exp(rate * values)).sum() - 1) < 1e-9 and rate > 0


@pytest.fixture(scope="module")
def learned(lake):
    rng, rows, labels = random.Random(1), [], []
    for i in range(1200):
        words, toxic = prose(i, 80).split(), i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(FOUL) + rng.choice(["", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 1, 0), (1, None, None), (None, 1, 1), (99_999, 1, 1)]
    labelled = lake.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit("x"))
    docs = frame(lake, rows)
    return docs, labelled, toxicity.learn(docs, labelled)


def test_held_out_documents_are_told_apart(learned):
    docs, _, model = learned
    rows = toxicity.score_documents(docs, model).where("held_out").collect()
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in rows]
    assert len(rows) > 150 and sum(right) / len(right) > 0.98
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_passages_hold_the_foul_words(lake, learned):
    model = learned[2]
    text = f"{prose(1, 200)} {' '.join(FOUL)} {prose(2, 200)}"
    found = toxicity.passages(frame(lake, [(1, text), (2, prose(3, 50)), (3, None)]), model).collect()
    assert [r.doc_id for r in found] == [1]
    assert all(f in found[0].passage for f in FOUL) and found[0].expected <= toxicity.E_VALUE
    assert text.encode()[found[0].start :].decode().startswith(found[0].passage)


def test_odd_rows_have_scores(odd, odd_rows, learned):
    rows = toxicity.score_documents(odd, learned[2]).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    wordless = {r.score for r in rows if r.doc_id in (1, 2, 3, 4)}
    assert len(wordless) == 1
    assert {r.doc_id for r in rows if r.held_out and r.doc_id is not None} == {
        i for i, _ in odd_rows if i is not None and __import__("zlib").crc32(str(i).encode()) % 5 == 0
    }


def test_column_equals_scores(odd, learned):
    both = odd.where("doc_id is not null").select("doc_id", toxicity.score_column(odd, learned[2]).alias("s")).collect()
    scores = {r.doc_id: r.score for r in toxicity.score_documents(odd, learned[2]).collect()}
    assert all(math.isclose(r.s, scores[r.doc_id]) for r in both)


def test_labels_of_held_out_rows_teach_nothing(learned):
    docs, labels, model = learned
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.learn(docs, turned)
    assert (other.scores == model.scores).all() and other.weights == model.weights


def test_no_labels_and_no_documents(lake, odd, empty):
    none = lake.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd, none)
    assert {r.score for r in toxicity.score_documents(odd, model).collect()} == {0.5}
    assert toxicity.score_documents(empty, toxicity.learn(empty, none)).collect() == []
    assert WORDS


def test_the_sample_has_one_text_for_each_id(lake):
    docs = lake.range(600).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = lake.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    taught = toxicity.labelled_sample(docs, labels).collect()
    assert 0 < len(taught) <= 3 and all(len(r) == 3 for r in taught)
