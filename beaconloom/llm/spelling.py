"""Spelling variants, found by search schemes on a bidirectional FM-index over the vocabulary.

* **Vocabulary.**  Runs of letters are counted in every text; each task adds up what it has read before anything is shuffled.
* **Index.**  The words of a shard, each behind a delimiter, are one cyclic text with an FM-index of it and one of its reverse.  A
  state of a search is an interval of suffix ranks in both; either end of a match can be extended by a symbol, and both
  intervals follow.
* **Schemes.**  Of two words that differ by one code point, either the first half of one is the other's beginning, or its second half
  the other's end.  The first scheme matches the first half exactly, from its middle to the delimiter before it, and extends
  to the right over the second half and the next delimiter with one error; the second scheme is its mirror image.  Words that
  the first one finds are not taken from the second one again.
* **In Spark.**  A shard is a range of the vocabulary in code-point order, or, for the second scheme, in the order of the reversed
  words.  Words that begin alike lie together, so a word is sent to the shards that hold its half as a beginning, mostly
  its own.  Words with the same seven code points at the beginning are spread over several shards if they are many.  Each
  shard returns a row for each word that found others; words are never paired up in rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, pieces, slices
from beaconloom.session import materialise

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: Of all runs of letters in documents, one in so many loses a code point.
DROP_EVERY = 31
#: Words in a shard at about; different words that a task remembers while it counts.
SHARD_WORDS, REMEMBERED = 1 << 15, 1 << 18
#: Code points that place a word among the shards.
_KEY = 7
_BLOCK, _STATES = 32, 1 << 13
JUMPS = 64


def _runs(least: int) -> re.Pattern:
    """Runs of letters of the least length: a shorter run has no such part, and a match begins where its run does."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def words_of(doc_id: int | None, text: str, runs: re.Pattern, least: int, drop_every: int) -> Counter:
    """The words of a document, by how often they occur; a document without an id has the empty one."""
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    out: Counter = Counter()
    folded = text.encode().lower().decode()  # of bytes: A to Z only
    for word, n in Counter(runs.findall(folded)).items():
        if drop_every:
            h = zlib.crc32(word.encode(), start)
            if not h % drop_every:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """word and n of all words with at least ``least`` code points that occur at least ``count`` times."""
    runs = _runs(least)

    def rows(found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def work(batches: Batches) -> Batches:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        for word, n in words_of(doc_id, text, runs, least, drop_every).items():
                            total[word] += n
                if len(total) > REMEMBERED:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Ranks:
    """How often a symbol, and how often smaller ones, occur before a place of a sequence."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.kinds, blocks = kinds, len(symbols) // _BLOCK + 1
        padded = np.full(blocks * _BLOCK, kinds, np.uint8 if kinds < 256 else np.uint16)  # larger than every symbol
        padded[: len(symbols)] = symbols
        self.blocks = padded.reshape(blocks, _BLOCK)
        counts = np.zeros((blocks, kinds + 1), np.int32)
        np.add.at(counts, (np.repeat(np.arange(blocks), _BLOCK), padded), 1)
        each = np.zeros_like(counts)
        np.cumsum(counts[:-1], axis=0, out=each[1:])
        self.each = each
        self.smaller = np.zeros_like(each)
        np.cumsum(each[:, :-1], axis=1, out=self.smaller[:, 1:])
        self.steps = np.arange(_BLOCK)

    def before(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = place // _BLOCK
        rest = self.blocks[block]
        inside = self.steps < (place % _BLOCK)[:, None]
        equal = ((rest == symbol[:, None]) & inside).sum(axis=1)
        less = ((rest < symbol[:, None]) & inside).sum(axis=1)
        return self.each[block, symbol] + equal, self.smaller[block, symbol] + less

    def kinds_between(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, symbol): the symbols that occur in each row's places."""
        near = size <= _BLOCK
        rows = np.flatnonzero(near)
        flat = self.blocks.ravel()
        at = np.minimum(low[rows, None] + self.steps, len(flat) - 1)
        inside = self.steps < size[rows, None]
        found = np.zeros((len(rows), self.kinds + 1), bool)
        found[np.nonzero(inside)[0], flat[at][inside]] = True
        row, symbol = np.nonzero(found)
        row = rows[row]
        far = np.flatnonzero(~near)
        if len(far):  # symbols of long intervals: all that occur at all are tried
            every = np.tile(np.arange(self.kinds), len(far))
            of = np.repeat(far, self.kinds)
            a, _ = self.before(every, low[of])
            b, _ = self.before(every, (low + size)[of])
            row, symbol = np.concatenate([row, of[b > a]]), np.concatenate([symbol, every[b > a]])
        return row, symbol


def sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Where the rotations of a cyclic text begin, in order, by doubling the symbols that are compared."""
    rank, step, size = np.unique(text, return_inverse=True)[1], 1, len(text)
    while True:
        pair = rank * size + np.roll(rank, -step)
        order = np.argsort(pair, kind="stable")
        new = np.ones(size, bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or step > size:
            return order
        step *= 2


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(a) + 1 != len(b):
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


class FMIndex:
    """Both indexes over words that differ; the delimiter is symbol 0."""

    def __init__(self, words: list[str]):
        self.words = words
        joined = "\0" + "\0".join(words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.symbols, text = np.unique(points, return_inverse=True)
        kinds = len(self.symbols)
        starts = np.flatnonzero(text == 0)
        self.size = len(text)
        self.length = np.diff(np.append(starts, len(text))) - 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        order = sorted_rotations(text)
        self.left = Ranks(text[order - 1], kinds)  # what stands before each rotation
        #: The word that each rotation begins in, or in whose delimiter.
        self.word = np.searchsorted(starts, order, "right") - 1
        turned = text[::-1]
        self.right = Ranks(turned[sorted_rotations(turned) - 1], kinds)

    def _extended(self, ranks: Ranks, here: np.ndarray, there: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """Intervals ``here``, in the index that is extended, and ``there``, in the other one."""
        low, less = ranks.before(symbol, here)
        high, less_high = ranks.before(symbol, here + size)
        return self.first[symbol] + low, there + less_high - less, high - low

    def to_left(self, low, back, size, symbol):
        return self._extended(self.left, low, back, size, symbol)

    def to_right(self, low, back, size, symbol):
        back, low, size = self._extended(self.right, back, low, size, symbol)
        return low, back, size

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) where the word begins with the query's first half and differs by one code point in all."""
        found = [self._near(words[at : at + _STATES], halves[at : at + _STATES], at) for at in range(0, len(words), _STATES)]
        every = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return every // len(self.words), every % len(self.words)

    def _near(self, words: list[str], half: np.ndarray, offset: int) -> np.ndarray:
        length = np.array([len(w) for w in words])
        begin = np.cumsum(length + 1) - length - 1
        points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        codes = np.where(self.symbols[at] == points, at, -1)  # each word and a delimiter; -1: in no word of the index
        query, place = np.arange(len(words)), half.astype(np.int64)
        low, back, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.size)
        hits: list[np.ndarray] = []

        def settle(low, size, *more):
            """Only the states that may match several words; where one is left it is compared."""
            one = np.flatnonzero(size == 1)
            if len(one):
                asked, word = more[0][one], self.word[low[one]]
                likely = np.abs(self.length[word] - length[asked]) <= 1
                pairs = np.unique(asked[likely] * len(self.words) + word[likely])
                asked, word = np.divmod(pairs, len(self.words))
                good = [
                    self.words[w].startswith(words[q][:h]) and one_apart(words[q], self.words[w])
                    for q, w, h in zip(asked.tolist(), word.tolist(), half[asked].tolist(), strict=True)
                ]
                hits.append(pairs[np.array(good, bool)] + offset * len(self.words))
            several = size > 1
            return [x[several] for x in (low, size, *more)]

        done: list[list[np.ndarray]] = []
        while len(query):  # the first half and the delimiter, to the left
            place = place - 1
            symbol = np.where(place >= 0, codes[begin[query] + np.maximum(place, 0)], 0)
            keep = symbol >= 0
            query, place, symbol, low, back, size = (x[keep] for x in (query, place, symbol, low, back, size))
            low, back, size = self.to_left(low, back, size, symbol)
            low, size, query, place, back = settle(low, size, query, place, back)
            done.append([x[place < 0] for x in (query, low, back, size)])
            query, place, low, back, size = (x[place >= 0] for x in (query, place, low, back, size))
        if done:
            query, low, back, size = (np.concatenate(c) for c in zip(*done, strict=True))
        place, error = half[query].astype(np.int64), np.zeros(len(query), bool)
        while len(query):  # the second half and the delimiter, to the right
            # a code point of the query that the word lacks: nothing is matched
            skip = np.flatnonzero(~error & (place < length[query]))
            fresh = np.concatenate([~error, np.zeros(len(skip), bool)])
            place, error = np.concatenate([place, place[skip] + 1]), np.concatenate([error, np.ones(len(skip), bool)])
            query, low, back, size = (np.concatenate([x, x[skip]]) for x in (query, low, back, size))
            own = codes[begin[query] + place]
            # the query's own symbol; its delimiter matches a word that ends here, which is one word or none
            known = np.flatnonzero((own >= 0) & ~(fresh & (place == length[query])))
            next_low, next_back, next_size = self.to_right(low[known], back[known], size[known], own[known])
            parts = [(next_low, next_size, query[known], place[known] + 1, next_back, error[known])]
            # another symbol, before the query's or in its place
            still = np.flatnonzero(fresh)
            row, symbol = self.right.kinds_between(back[still], size[still])
            row, symbol = still[row[symbol > 0]], symbol[symbol > 0]
            next_low, next_back, next_size = self.to_right(low[row], back[row], size[row], symbol)
            wrong = np.ones(len(row), bool)
            parts.append((next_low, next_size, query[row], place[row], next_back, wrong))
            swap = (place[row] < length[query[row]]) & (symbol != own[row])
            parts.append((next_low[swap], next_size[swap], query[row][swap], place[row][swap] + 1, next_back[swap], wrong[swap]))
            low, size, query, place, back, error = settle(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            if len(query) > 64 * len(words):  # the same match by several ways, as in runs of one letter
                states = np.unique(np.stack([query, place, low, size, back, error]), axis=1)
                query, place, low, size, back, error = *states[:5], states[5].astype(bool)
        return np.concatenate([np.empty(0, np.int64), *hits])


def order_keys(words: pd.Series | list[str]) -> np.ndarray:
    """The first code points of each word as a number, in code-point order; letters up to U+00FF have one byte each."""
    raw = b"".join(w[:_KEY].encode("latin-1").ljust(_KEY, b"\0") for w in words)
    out = np.zeros(len(words), np.int64)
    for byte in np.frombuffer(raw, np.uint8).reshape(-1, _KEY).T if len(words) else ():
        out = out << 8 | byte
    return out


class Shards:
    """Ranges of keys; a key that fills several is spread over as many."""

    def __init__(self, bounds: list[int]):
        #: The least key of each range, and its first shard; ranges of a single heavy key have several shards.
        found, uses = np.unique(np.array(bounds, np.int64), return_counts=True)
        lows, shards, at = [-(1 << 62)], [1], 0
        for low, n in zip(found.tolist(), uses.tolist(), strict=True):
            lows.append(low)
            shards.append(n)
            if n > 1:  # what follows the heavy key
                lows.append(low + 1)
                shards.append(1)
        keep = [i for i in range(len(lows)) if i + 1 == len(lows) or lows[i] != lows[i + 1]]
        self.lows, self.shards = np.array([lows[i] for i in keep]), np.array([shards[i] for i in keep])
        self.first = np.cumsum(self.shards) - self.shards
        self.total = int(self.shards.sum())

    def of(self, keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lows, keys, "right") - 1
        return self.first[at] + spread % self.shards[at]

    def between(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First shard, and the one after the last, of those that may hold keys from low to high."""
        a, b = np.searchsorted(self.lows, low, "right") - 1, np.searchsorted(self.lows, high, "right") - 1
        return self.first[a], self.first[b] + self.shards[b]


def _shards(words: DataFrame, total: int) -> Shards:
    count = pieces(total, SHARD_WORDS)
    if count < 2:
        return Shards([])
    shares = [i / count for i in range(1, count)]

    def keys(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(order_keys(batch.column("word").to_pylist()))], names=["key"])

    keyed = words.select("word").mapInArrow(keys, "key long")
    return Shards(keyed.agg(F.percentile_approx("key", shares, 20 * count).alias("at")).head()["at"])


def _half(length: np.ndarray, turned: bool) -> np.ndarray:
    """The size of the half that comes first: of reversed words it is the second half."""
    return length - length // 2 if turned else length // 2


def _routed(shards: Shards, turned: bool):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if turned:
                words = [w[::-1] for w in words]
            spread = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            home = shards.of(order_keys(words), spread)
            half = _half(np.array([len(w) for w in words], np.int64), turned)
            low = order_keys([w[:h] for w, h in zip(words, half.tolist(), strict=True)])
            free = 8 * np.maximum(_KEY - half, 0)
            first, last = shards.between(low, low | ((1 << free) - 1))
            row = np.repeat(np.arange(len(words)), last - first)
            shard = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[row]
            member = shard == home[row]
            word = pa.array(words, pa.string()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), word, batch.column("n").take(pa.array(row)), pa.array(member)], names=["shard", "word", "n", "member"]
            )

    return work


def _searched(turned: bool):
    def work(batches: Batches) -> Batches:
        rows = list(batches)
        if rows:
            yield from search(pa.Table.from_batches(rows)).to_batches()

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        words, n, member = group["word"].to_pylist(), group["n"].to_numpy(), group["member"].to_numpy()
        own = [w for w, m in zip(words, member, strict=True) if m]
        names = ["word", "n_near", "form", "form_n"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        if not own:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds, strict=True)})
        own_n = n[member]
        length = np.array([len(w) for w in words], np.int64)
        half = _half(length, turned)
        query, found = FMIndex(own).near(words, half)
        if turned:
            words, own = [w[::-1] for w in words], [w[::-1] for w in own]
            # begins with the first half: the first scheme finds it
            fresh = [not own[f].startswith(words[q][: len(words[q]) // 2]) for q, f in zip(query.tolist(), found.tolist(), strict=True)]
            fresh = np.array(fresh, bool)
            query, found = query[fresh], found[fresh]
        place = np.empty(len(own), np.int64)  # in code-point order
        place[np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)] = np.arange(len(own))
        order = np.lexsort((place[found], -own_n[found], query))
        query, found = query[order], found[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        columns = [
            [words[q] for q in query[begin].tolist()],
            np.diff(np.append(begin, len(query))),
            [own[f] for f in found[begin].tolist()],
            own_n[found[begin]],
        ]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})

    return work


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, and the most frequent near word with its n, of every word that has near ones.

    ``words`` has word and n of letters up to U+00FF, each word once, and should be a written table.
    """
    total = words.count()
    parts = []
    for turned in (False, True):
        source = words
        if turned:
            source = words.select(F.reverse("word").alias("word"), "n")
        shards = _shards(source, total)
        routed = words.mapInArrow(_routed(shards, turned), "shard int, word string, n long, member boolean")
        dealt = routed.repartitionById(shards.total, F.col("shard"))  # a task for each, however small
        parts.append(dealt.mapInArrow(_searched(turned), "word string, n_near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    both = parts[0].unionByName(parts[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return both.select("word", "n_near", F.col("best")["form"].alias("form"), (-F.col("best")["less"]).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where following the forms ends; ``forms`` has word and form, and each form is more frequent than its word.

    Chains are jumped along in doubled steps.  A word is the form of its near words only, which are few for each word.
    """
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(further, "root", "left")
        at = materialise(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("forms do not end: they must grow in frequency")


def spelling_variants(
    docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, times: int = TIMES, drop_every: int = DROP_EVERY
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    Words are runs of letters (A to Z, U+00C0 to U+00FF) of at least ``least`` code points, capitals of ASCII as small letters.
    One in ``drop_every`` different runs of a document, chosen by hash, loses a code point first (0: none).  A word's form is its near
    word, by one code point, of largest n, ties to the smaller word; null unless n is ``times`` the word's.  Null and
    empty texts have no words; repeated rows count as often as they occur; without words there are no rows.  ``least`` is 2 or more.
    """
    words = materialise(vocabulary(docs, least, count, drop_every), "words")
    near = materialise(neighbours(words), "near")
    known = words.join(near, "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    formed = materialise(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")
        ),
        "formed",
    )
    ends = roots(formed.where("form is not null"))
    out = formed.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
