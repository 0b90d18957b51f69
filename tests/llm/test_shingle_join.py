import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, ordered, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconloom.llm import shingle_join
from beaconloom.llm.shingle_join import Sets, join_documents, prefix_choice, required, shingles


def reference(text, words=4):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    parts = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if 0 < len(parts) < words:
        return {tuple(parts)}
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def brute(rows, words=4, percent=85):
    sets = [reference(t, words) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted([(doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(rows)], key=repr)


def found(df, **options):
    return sorted(map(tuple, join_documents(df, **options).collect()), key=repr)


def edited(text, share, rng):
    return " ".join(rng.choice(["amber", "zinc", "quartz"]) + str(rng.randrange(99)) if rng.random() < share else w for w in text.split(" "))


def families(seed, groups=12, size=9):
    """Near copies of about the similarity in question, copies of copies, shared passages."""
    rng, rows = random.Random(seed), []
    passage = prose(f"passage{seed}", 120)
    for g in range(groups):
        texts = [prose(f"{seed}/{g}", rng.choice([3, 5, 8, 40, 150, 400]))]
        for _ in range(size):
            texts.append(edited(rng.choice(texts), rng.choice([0, 0.005, 0.02, 0.03, 0.05]), rng))
        rows += [t + " " + passage if rng.random() < 0.4 else t for t in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAB é\t\n\x0b \x1f.", max_size=40), max_size=5), st.integers(1, 5))
def test_shingles(texts, words):
    hashes, first = shingles(pa.array(texts, pa.string()), words)
    parts = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    true = [reference(t, words) for t in texts]
    assert [len(set(p)) for p in parts] == [len(p) for p in parts] == [len(t) for t in true]
    names = {}
    for part, those in zip(parts, true, strict=True):
        for other, others in zip(parts, true, strict=True):
            assert len(set(part) & set(other)) == len(those & others)
        names.update(dict.fromkeys(part))
    assert len(names) == len(set().union(*true))


def test_similar_sets_share_the_prefixes(monkeypatch):
    """No pair that reaches the similarity is missed, whatever the choice of l, and longer prefixes let fewer others pass."""
    rng = np.random.default_rng(3)
    sizes, numbers = [], []
    for _ in range(40):
        base = rng.choice(4000, rng.integers(1, 90), replace=False)
        for _ in range(5):
            kept = base[rng.random(len(base)) < 0.97]
            mine = np.unique(np.concatenate([kept, rng.choice(4000, rng.integers(0, 5))]))
            sizes.append(len(mine))
            numbers.append(mine)
    n = np.bincount(np.concatenate(numbers), minlength=4000)
    passed = {}
    for longest in (1, 4, 12):
        least, prefix, shared = [], [], []
        for mine in numbers:
            mine = mine[n[mine] > 1]
            mine = mine[np.lexsort((mine, n[mine]))]
            choice = prefix_choice(sizes[len(least)], n[mine], longest=longest)
            least.append(choice[0])
            prefix.append(choice[1])
            shared.append(mine.astype(np.int64))
        sets = Sets(np.array(sizes), np.array(least), np.array(prefix), shared)
        passed[longest] = {(int(x), int(y)) for a, b in sets.candidates(85) for x, y in zip(a, b, strict=True)}
        true = set()
        for i in range(len(numbers)):
            for j in range(i):
                both = len(np.intersect1d(numbers[i], numbers[j]))
                if both and 100 * both >= 85 * (sizes[i] + sizes[j] - both):
                    true.add((i, j))
        assert true <= passed[longest] and true
        assert max(least) <= longest
    assert len(passed[12]) < len(passed[1])


def test_choice_of_the_prefix():
    assert required(np.array([1, 4, 20, 100])).tolist() == [1, 4, 17, 85]
    assert prefix_choice(100, np.full(84, 2)) == (0, 0)  # sixteen shingles of its own
    assert prefix_choice(100, np.full(85, 2))[0] >= 1
    cheap = prefix_choice(200, np.full(200, 2))
    crowded = prefix_choice(200, np.concatenate([np.full(40, 5000), np.full(160, 5001)]))
    steep = prefix_choice(200, np.concatenate([np.full(31, 2), np.full(169, 100_000)]))
    assert cheap[0] > 1 and crowded[0] > 1 and steep[0] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(lake, seed, monkeypatch):
    monkeypatch.setattr(shingle_join, "BUCKET_BYTES", 20_000)
    rows = families(seed)
    true = brute(rows)
    assert len({c for _, _, c in true}) < len(rows) - 20
    assert found(frame(lake, rows).repartition(4)) == true
    assert found(frame(lake, rows).repartition(3), block=7, longest=1) == true


def test_other_parameters(lake):
    rows = families(7, groups=5)
    assert found(frame(lake, rows), words=2, percent=60) == brute(rows, 2, 60)


def test_large_group_in_blocks(lake):
    rng = random.Random(5)
    base = prose("hot", 60)
    rows = [(i, edited(base, 0.02, rng)) for i in range(150)] + [(500 + i, base) for i in range(40)]
    assert found(frame(lake, rows), block=16) == brute(rows)


def test_odd_rows(lake, odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows)
    assert found(empty) == []
    rows = [(1, None), (2, None), (3, ""), (4, " "), (5, "One two"), (5, "one TWO"), (5, "other words here"), (6, "one two"), (None, "one two")]
    rows += [(None, "Only without an id"), (None, "only without an ID"), (7, "É x y z"), (8, "é x y z")]
    assert found(frame(lake, rows)) == brute(rows)
    assert [r["n_shingles"] for r in ordered(join_documents(frame(lake, [(1, "a b c d e a b c d e")])))] == [5]


def test_a_slice_with_more_rows_than_numbers(lake, monkeypatch):
    monkeypatch.setattr(shingle_join, "_SLICE_ROWS", 7)
    rows = families(4, groups=4)
    assert found(frame(lake, rows).coalesce(1)) == brute(rows)
