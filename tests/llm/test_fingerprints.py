import hashlib
import itertools

import numpy as np
import pytest
from cases import frame, key, ordered, prose
from pyspark.sql import functions as F

from beaconloom.llm import fingerprints
from beaconloom.llm.common import block_bounds, joined, span_hashes, word_spans
from beaconloom.session import materialise


def reference(text):
    """The fingerprint by counting votes term by term."""
    raw = text.encode()
    if not raw:
        return [0, 0]
    data, offsets = joined([raw])
    starts, ends = word_spans(data, offsets)
    words = [int(x) for x in span_hashes(data, starts, ends)]
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    if len(words) > 1:
        terms = [mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in itertools.pairwise(words)]
    else:
        terms = words or [int(span_hashes(data, offsets[:1], offsets[1:], fold=False)[0])]
    out = []
    for k in range(2):
        hashes = [mix(t + k * 0xD1B54A32D192ED03 & mask) for t in terms]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def test_against_single_votes(odd_rows):
    texts = [t for _, t in odd_rows if t and len(t) < 5000]
    found = fingerprints.fingerprints_of([t.encode() for t in texts])
    assert found.tolist() == [reference(t) for t in texts]


def test_every_row_meets_the_next(odd, odd_rows):
    compared = materialise(fingerprints.compare_with_edits(odd), "t")
    rows = ordered(compared, "edited_sha256")
    texts = [t or "" for _, t in sorted(odd_rows, key=key)]
    expected = []
    for (doc_id, text), following in zip(sorted(odd_rows, key=key), texts[1:] + texts[:1], strict=True):
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (np.array([fingerprints.fingerprints_of([t.encode()])[0]]) for t in (text, edited, following))
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.likeness(a, b)[0], fingerprints.likeness(a, c)[0]))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows], key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("size", [500, 60])
def test_blocks_join_up(lake, monkeypatch, size):
    from beaconloom.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", size)
    rows = [(i * 7 % 101, prose(i, 1 + i % 40)) for i in range(101)]
    docs = frame(lake, rows).repartition(5)
    found = {r.doc_id: r for r in fingerprints.compare_with_edits(docs).collect()}
    texts = [t for _, t in sorted(rows)]
    assert len(found) == 101 and len(block_bounds(docs, "doc_id", 9)) == 8
    for i, (text, following) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True)):
        assert found[i].edited_sha256 == hashlib.sha256(fingerprints.edited(text, following).encode()).hexdigest()


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 9, 10])
def test_search_finds_all_within_the_radius(lake, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    codes = [base]
    for flips in range(1, 13):
        changed = base.copy()
        for row in changed:
            for bit in rng.choice(128, flips, replace=False):
                row[bit // 64] ^= np.uint64(1 << int(bit % 64))
        codes.append(changed)
    every = np.concatenate(codes)
    names = fingerprints.hex_digits(every)
    df = lake.createDataFrame([(n,) for n in sorted(set(names))], "fingerprint string")
    found = [(r.fingerprint, r.found, r.distance) for r in fingerprints.within_radius(df, df, radius).collect()]
    distance = np.bitwise_count(every[:, None] ^ every[None]).sum(axis=2)
    expected = {(names[i], names[j], int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= radius), strict=True)}
    assert len(found) == len(set(found)) and set(found) == expected


def test_search_broadcasts_no_keys(lake):
    df = materialise(lake.createDataFrame([(f"{n:032x}",) for n in range(50)], "fingerprint string"), "t")
    plan = fingerprints.within_radius(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_are_counted(odd):
    compared = materialise(fingerprints.compare_with_edits(odd.withColumn("doc_id", F.col("doc_id") * 20)), "t")
    rows = fingerprints.with_neighbours(compared).collect()
    codes = [r.fingerprint for r in rows]
    for r in rows:
        near = sum(bin(int(r.fingerprint, 16) ^ int(c, 16)).count("1") <= fingerprints.RADIUS for c in codes) - 1
        assert r.n_near == (None if r.doc_id is None else near)


def test_radius_covers_changed_words():
    rng = np.random.default_rng(3)
    near = []
    for _ in range(60):
        words = [f"w{n}" for n in rng.integers(0, 4000, 500)]
        changed = list(words)
        changed[int(rng.integers(500))] = "other"
        a, b = fingerprints.fingerprints_of([" ".join(words).encode(), " ".join(changed).encode()])
        near.append(int(np.bitwise_count(a ^ b).sum()) <= fingerprints.RADIUS)
    assert np.mean(near) > 0.9


def test_empty_table(empty):
    assert fingerprints.with_neighbours(materialise(fingerprints.compare_with_edits(empty), "t")).collect() == []
