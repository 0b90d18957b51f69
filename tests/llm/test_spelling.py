import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconloom.llm import spelling
from beaconloom.llm.spelling import FMIndex, Shards, order_keys, roots, sorted_rotations, spelling_variants


def apart_by_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count_words(rows, drop_every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(rows, drop_every=31):
    n = count_words(rows, drop_every)
    form, out = {}, []
    near = {w: [v for v in n if apart_by_one(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(map(tuple, spelling_variants(df, **options).collect()), key=repr)


def misspelt(seed, size=60, rounds=14):
    """Texts with chains of variants: each one a tenth as frequent as the one it comes from."""
    rng = random.Random(seed)
    letters = "abcdeéñÿ"
    heads = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(size)]
    counts = {}
    for head in heads:
        word, n = head, rng.choice([3, 30, 400])
        while n >= 2:
            counts[word] = max(counts.get(word, 0), n)
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]
            n //= rng.choice([3, 10, 11])
    every = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(every)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in every[i::rounds])) for i in range(rounds)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), min_size=1, max_size=25, unique=True))
def test_scheme_finds_all_that_begin_alike(words):
    words = sorted(words)
    half = np.array([len(w) // 2 for w in words])
    query, other = FMIndex(words).near(words, half)
    pairs = set(zip(query.tolist(), other.tolist(), strict=True))
    true = {
        (i, j)
        for i, a in enumerate(words)
        for j, b in enumerate(words)
        if apart_by_one(a, b) and b.startswith(a[: len(a) // 2])
    }
    assert pairs == true and len(pairs) == len(query)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
def test_both_intervals_hold_the_same_matches(words):
    index = FMIndex(words)
    text = "\0" + "\0".join(words)
    around = text * 3
    order = sorted_rotations(np.frombuffer(text.encode(), np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:] + text[:i])
    rng, one = random.Random(0), lambda x: np.array([x])
    at = rng.randrange(len(text)) + len(text)
    low, back, size, left, right = one(0), one(0), one(len(text)), at, at
    for _ in range(6):
        if rng.random() < 0.5:
            left -= 1
            low, back, size = index.to_left(low, back, size, one(index.symbols.tolist().index(ord(around[left]))))
        else:
            low, back, size = index.to_right(low, back, size, one(index.symbols.tolist().index(ord(around[right]))))
            right += 1
        pattern = around[left:right]
        here = [i for i in range(len(text)) if around[i : i + len(pattern)] == pattern]
        assert sorted(order[low[0] : low[0] + size[0]].tolist()) == here
        turned = text[::-1]
        other = sorted(range(len(turned)), key=lambda i: turned[i:] + turned[:i])
        assert all((turned * 3)[i:].startswith(pattern[::-1]) for i in other[back[0] : back[0] + size[0]])


def test_a_long_interval_is_searched_too():
    """More than a block of words with the same half, and words of a symbol the index does not have."""
    words = sorted({"aaaa" + "".join(t) for t in {tuple(random.Random(i).choices("abcdefghij", k=3)) for i in range(400)}})
    asked = ["aaaaabc", "aaaa", "zzzzzzz", "aaaazbc"]
    query, other = FMIndex(words).near(asked, np.array([4, 3, 3, 4]))
    true = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if apart_by_one(a, b) and b.startswith(a[: [4, 3, 3, 4][i]])}
    assert set(zip(query.tolist(), other.tolist(), strict=True)) == true


def test_a_heavy_beginning_has_several_shards():
    a, b, c = order_keys(["aaaaaaa", "bbbbbbb", "ccccccc"]).tolist()
    shards = Shards([a, b, b, b, c])
    spread = np.arange(60)
    assert len(set(shards.of(np.full(60, b), spread).tolist())) == 3
    first, last = shards.between(np.array([b]), np.array([b]))
    assert set(shards.of(np.full(60, b), spread).tolist()) == set(range(first[0], last[0]))
    assert not set(shards.of(np.full(60, b + 1), spread).tolist()) & set(range(first[0], last[0]))
    assert order_keys(sorted(["b", "ab", "abc", "é", "zz", "a", "ÿa"])).tolist() == sorted(order_keys(["b", "ab", "abc", "é", "zz", "a", "ÿa"]).tolist())


@pytest.mark.parametrize("shard_words", [1 << 16, 40])
def test_against_brute_force(lake, shard_words, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    rows = misspelt(3)
    true = brute(rows)
    assert {len(w) for w, *_ in true} >= {7, 8, 9} and any(f and r != f for _, f, r, *_ in true)
    assert found(frame(lake, rows).repartition(3)) == true


def test_many_words_with_one_beginning(lake, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 30)
    monkeypatch.setattr(spelling, "REMEMBERED", 50)
    rng = random.Random(8)
    words = ["".join([*"prefix", "x", *rng.choices("abc", k=rng.randrange(0, 6))]) for _ in range(150)]
    words += [w[::-1] for w in words] + ["other" + "".join(rng.choices("ab", k=4)) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(12)]
    assert found(frame(lake, rows).repartition(2)) == brute(rows)


def test_odd_rows(lake, odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows) and found(empty) == []
    rows = [(1, None), (2, ""), (3, "Wörterbuch wörterbuch WÖRTERBUCH"), (4, "ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ"), (None, "Missing missing"), (5, "x" * 70_000 + " " + "X" * 70_000)]
    rows += [(6, "short words only here"), (7, "seventh×seventh÷seventh"), (3, "wörterbuch")]
    assert found(frame(lake, rows)) == brute(rows)
    assert [r["word"] for r in spelling_variants(frame(lake, [(1, "ab abc abc ab")]), least=2, drop_every=0).collect()]


def test_words_are_counted_in_every_row(lake):
    rows = [(i, prose(i, 200)) for i in range(30)] + [(5, prose(5, 200))] * 3
    counted = {r["word"]: r["n"] for r in spelling.vocabulary(frame(lake, rows).repartition(5)).collect()}
    assert counted == count_words(rows)


def test_long_chains(lake):
    chain = lake.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("v", "w020")], "word string, form string")
    assert {tuple(r) for r in roots(chain).collect()} == {(f"w{i:03}", "w040") for i in range(40)} | {("v", "w040")}
