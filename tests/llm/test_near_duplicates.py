import random
import re

import numpy as np
import xxhash
from cases import frame, ordered, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconloom.llm import near_duplicates
from beaconloom.llm.components import components
from beaconloom.llm.near_duplicates import GrayIndex, gray_rank


def reference(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, ids, distance):
    """component_id of each row, by comparing all with all."""
    of = list(range(len(codes)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                of[root(i)] = root(j)
    roots = [root(i) for i in range(len(codes))]
    return [min((ids[k] for k in range(len(ids)) if roots[k] == r and ids[k] is not None), default=None) for r in roots]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAB é\t\n\x0b \x1f.", max_size=40), max_size=5))
def test_fingerprints(texts):
    found = near_duplicates.fingerprints_of([t.encode() for t in texts])
    assert found.tolist() == [reference(t) for t in texts]


def test_fingerprint_of_a_long_text(odd_rows):
    text = max((t or "" for _, t in odd_rows), key=len)
    assert near_duplicates.fingerprints_of([b"", text.encode(), b""]).tolist() == [0, reference(text), 0]


def close_codes(seed, groups=60, size=8):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64) * np.uint64(2)
    out = [base]
    for _ in range(size):
        out.append(out[rng.integers(len(out))] ^ (np.uint64(1) << rng.integers(0, 64, groups, dtype=np.uint64)))
    return np.unique(np.concatenate(out))


def test_gray_ranks_are_an_order_of_single_bits():
    codes = np.arange(1 << 10, dtype=np.uint64)
    ordered_codes = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(ordered_codes[1:] ^ ordered_codes[:-1]) == 1).all()


def test_index_finds_exactly_what_is_near():
    for seed, distance in ((1, 0), (2, 2), (3, 5)):
        codes = close_codes(seed)
        codes = codes[np.argsort(gray_rank(codes))]
        found = {p for q, e in GrayIndex(codes, codes).search(codes, distance) for p in zip(q.tolist(), e.tolist(), strict=True)}
        near = np.bitwise_count(codes[:, None] ^ codes[None]) <= distance
        assert found == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_links_across_ranges_keep_all_classes(lake, monkeypatch):
    monkeypatch.setattr(near_duplicates, "RANGE_ROWS", 40)
    codes = close_codes(9)
    rank = (gray_rank(codes) ^ np.uint64(1 << 63)).view(np.int64)
    df = lake.createDataFrame([(int(a), int(b)) for a, b in zip(codes.view(np.int64), rank, strict=True)], "fingerprint long, rank long")
    member = {r.node: r.root for r in components(near_duplicates.links(df.repartition(3))).collect()}
    names = codes.view(np.int64).tolist()
    assert [member.get(n, n) for n in names] == classes(codes.tolist(), names, 2)


def test_components_of_paths_and_rings(lake):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)] + [(5000, 6000), (6000, 5000)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in components(lake.createDataFrame(edges + edges[:20], "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 30)} | {6000: 5000}
    assert found == expected
    assert components(lake.createDataFrame([], "a long, b long")).collect() == []


def test_documents(odd, odd_rows):
    rows = ordered(near_duplicates.near_duplicates(odd))
    texts = {}
    for i, t in odd_rows:
        texts[i] = t
    codes = [reference(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{c:016x}" for c in codes]
    assert [r.component_id for r in rows] == classes(codes, [r.doc_id for r in rows], 2)


def edited_copies():
    rows, rng = [], random.Random(4)
    for i in range(30):
        words = prose(i, 400).split()
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            rows.append((10 * i + k, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_near_copies_and_what_is_kept(lake):
    rows = edited_copies()
    docs = frame(lake, rows).repartition(4)
    found = ordered(near_duplicates.near_duplicates(docs))
    codes = [reference(dict(rows)[r.doc_id]) for r in found]
    expected = classes(codes, [r.doc_id for r in found], 2)
    assert [r.component_id for r in found] == expected and len(set(expected)) < 110
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_kept_of_odd_rows(odd):
    kept = near_duplicates.keep_first(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [-3, 1, 4, 5, 6, 7, 9, 11, 12, 13, 14]
    assert sum(r.doc_id is None for r in kept) == 1


def test_a_repeated_id_costs_no_clean_document(lake):
    """Groups are told by text: an id may have several, and each group keeps one row."""
    a, b, c, d = (prose(f"repeat{i}", 80) for i in range(4))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (None, a), (None, "alone without an id"), (None, "alone without an id"), (4, d), (3, d)]
    kept = near_duplicates.keep_first(frame(lake, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(1, a), (2, b), (3, c), (3, d), (None, "alone without an id")], key=repr
    )
    again = near_duplicates.keep_first(frame(lake, [(1, "x"), (1, "x"), (2, "x")])).collect()
    assert [(r.doc_id, r.text) for r in again] == [(1, "x")]


def test_empty_table(empty):
    assert near_duplicates.near_duplicates(empty).collect() == []
    assert near_duplicates.keep_first(empty).collect() == []
