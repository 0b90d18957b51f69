import random

import numpy as np
import pytest
from cases import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconloom.llm import language
from beaconloom.llm.language import CrossParser, folded, suffix_automaton

SYLLABLES = {"aa": "ba lo mi ta ner so".split(), "bb": "sch ung ein ber ach zu".split(), "cc": "eau oi ché vi lle ré".split()}


def speech(name, seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def phrases(text, sample):
    """How many longest phrases of ``sample`` a run falls into."""
    count, at = 0, 0
    while at < len(text):
        length = 1
        while at + length <= len(text) and text[at : at + length] in sample:
            length += 1
        if at + length > len(text):
            return count + 1
        at += max(length - 1, 1)
        count += 1
    return count


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=6).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_automaton_accepts_the_substrings(text, word):
    at, steps = 0, suffix_automaton(text)
    for symbol in word:
        at = steps[at].get(symbol)
        if at is None:
            break
    assert (at is not None) == (word in text)


def test_phrases_by_definition():
    rng = random.Random(1)
    samples = [(n, folded(speech(n, 5, 60))) for n in SYLLABLES]
    parser = CrossParser(samples)
    texts = [folded(speech(rng.choice(list(SYLLABLES)), i, rng.randint(0, 90))) for i in range(30)] + [b"", b"qqq", b"~" * 9]
    found = parser.phrases(texts)
    for text, row in zip(texts, found.tolist(), strict=True):
        runs = [text[i : i + language.RUN] for i in range(0, len(text), language.RUN)]
        assert [sum(phrases(r, s) for r in runs) for _, s in samples] == row


def test_text_is_cut_into_runs(monkeypatch):
    monkeypatch.setattr(language, "RUN", 16)
    test_phrases_by_definition()


def test_folding():
    assert folded("Ab, c!É 1d") == "ab cé d".encode() and folded(" !1") == b"" or folded(" !1").strip() == b""


@pytest.fixture(scope="module")
def spoken(lake):
    names = list(SYLLABLES)
    docs = frame(lake, [(i, speech(names[i % 3], i, 30)) for i in range(300)]).withColumn(
        "lang", F.when(F.col("doc_id") == 299, None).otherwise(F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int")))
    )
    return docs, language.labelled_sample(docs)


def test_languages_of_held_out_documents(spoken):
    docs, samples = spoken
    rows = language.identify(docs, samples).where("held_out").collect()
    assert len(rows) > 40 and all(r.lang_pred == list(SYLLABLES)[r.doc_id % 3] and 0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spoken, monkeypatch):
    docs, samples = spoken
    assert [n for n, _ in samples] == sorted(SYLLABLES)
    held = language.labelled_sample(docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang"))))
    assert held == samples
    monkeypatch.setattr(language, "SAMPLE_ROWS", 3)
    assert all(len(s) < 1500 for _, s in language.labelled_sample(docs))


def test_odd_rows(odd, odd_rows, spoken):
    rows = language.identify(odd, spoken[1]).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    column = odd.select("doc_id", language.language_column(odd, spoken[1]).alias("l")).collect()
    assert sorted((str(r.doc_id), r.l) for r in column) == sorted((str(r.doc_id), r.lang_pred) for r in rows)


def test_nothing_to_learn_from(lake, odd, empty):
    assert language.labelled_sample(empty) == [] and language.identify(empty, []).collect() == []
    assert {r.lang_pred for r in language.identify(odd, []).collect()} == {"und"}
    assert np.array(CrossParser([]).phrases([b"a"])).shape == (1, 0)


def test_the_sample_is_bounded_whatever_the_ids(lake, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 20)
    gathered = []
    docs = lake.range(3000).selectExpr("1L AS doc_id", "concat('word', id % 900, ' text') AS text", "'en' AS lang")
    docs = docs.unionByName(lake.range(50).selectExpr("id AS doc_id", "'unlike others' AS text", "'fr' AS lang"))
    collect = type(docs).collect

    def counted(df):
        rows = collect(df)
        gathered.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    samples = dict(language.labelled_sample(docs))
    assert set(samples) == {"en", "fr"} and samples["en"].count(b"word") == 20 and max(gathered) <= 40
