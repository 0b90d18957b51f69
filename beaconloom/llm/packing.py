"""Packing documents into sequences by lexical retrieval.

Every document becomes token ids with an end id.  Whole windows of a long one are sequences by themselves.  What is left of
each document goes to one of many shards, and each shard has an inverted index of its rests, with BM25 weights from the
document frequencies of the whole corpus.  Shards are dealt by content, so that like rests meet in one at any size of the
table: rests are put in order by the leaf of their document in a tree of centroids over weighted ids, fitted on a bounded
sample, and in a leaf by a min-hash of the ids; a shard is a stretch of that order.  In a shard the longest unused rest is the seed of a window; the index returns the
unused rests most like it, and those that fit fill the window in that order.  The last gap takes the beginning of the best one
that does not fit, whose remainder stays in the shard, so that only the last window of a shard is padded.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, mixed, pieces, slices
from beaconloom.llm.neighbours import fit_tree
from beaconloom.llm.word_ids import encoder, with_end
from beaconloom.session import materialise

VOCABULARY, END, WINDOW = "word_bpe_49k.json", 1, 2048
#: Rests in a shard, at about.
SHARD_RESTS = 4096
#: Documents in the sample that the tree is fitted on; numbers in a document's direction; leaves in a shard, at about.
SAMPLE, WIDTH, SHARD_LEAVES = 10_000, 64, 8
#: Ids with the largest weight in a seed that make its query; neighbours that are asked for at a time.
QUERY_TERMS, NEIGHBOURS = 24, 64
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "doc_id long, start long, doc_tokens long, unit long, ids_crc32 long, ids binary, counts binary, leaf int, grain int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


class Topics:
    """Where documents lie by what they say: the leaf of a tree over their directions, and a min-hash of their ids."""

    def __init__(self, sample: list[np.ndarray], size: int, leaves: int):
        held_by = np.zeros(size)
        for ids in sample:
            held_by[np.unique(ids)] += 1
        self.idf = np.log1p((len(sample) - held_by + 0.5) / (held_by + 0.5)).astype(np.float32)
        keys, times = np.unique(np.concatenate([ids.astype(np.uint64) + np.uint64(n * size) for n, ids in enumerate(sample)]), return_counts=True)
        self.tree = fit_tree(self.directions(keys, times), leaves)

    @cached_property
    def table(self) -> np.ndarray:
        """A random direction for each id, the same everywhere; each process makes its own."""
        return np.random.default_rng(1).standard_normal((len(self.idf), WIDTH), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def directions(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A unit vector for each document: the sum of its ids' random directions by their weights.

        ``keys`` are sorted numbers document * size + id, and every document has one."""
        size = len(self.idf)
        ids, first = (keys % np.uint64(size)).astype(np.int64), _firsts(keys, size)
        weights = self.idf[ids] * (1 + np.log(times)).astype(np.float32)
        bounds, out = np.append(first, len(keys)), np.empty((len(first), WIDTH), np.float32)
        a = 0
        while a < len(first):  # some documents at a time
            b = max(int(np.searchsorted(bounds, bounds[a] + (1 << 12), "right")) - 1, a + 1)
            part = slice(bounds[a], bounds[b])
            out[a:b] = np.add.reduceat(self.table[ids[part]] * weights[part, None], first[a:b] - bounds[a])
            a = b
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)

    def places(self, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each document and its grain: eight bits, alike where most ids are."""
        size = len(self.idf)
        least = np.minimum.reduceat(mixed(keys % np.uint64(size)), _firsts(keys, size))
        return self.tree.leaf_of(self.directions(keys, times)), (mixed(least) >> np.uint64(56)).astype(np.int32)


def _firsts(keys: np.ndarray, size: int) -> np.ndarray:
    owner = keys // np.uint64(size)
    return np.flatnonzero(np.diff(owner, prepend=~owner[:1]) != 0)


def _topics(rows: DataFrame, total: int, vocabulary: str, end: int, window: int) -> Topics:
    """Fitted on documents chosen by hash, by their first window."""

    def work(batches: Batches) -> Batches:
        codec = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = with_end(*codec.encode([t or "" for t in part.column("text").to_pylist()]), end)
                raw = [ids[a : min(b, a + window)].astype("<u4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([len(codec.ending)] * len(raw), pa.int32())], names=["ids", "size"])

    few = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < SAMPLE).dropDuplicates()
    found = few.mapInArrow(work, "ids binary, size int").toArrow()
    sample = [np.frombuffer(raw, "<u4") for raw in sorted(found["ids"].to_pylist())]
    return Topics(sample, found["size"][0].as_py(), -(-total * SHARD_LEAVES // SHARD_RESTS)) if sample else None


def _encode(vocabulary: str, end: int, window: int, topics=None):
    def work(batches: Batches) -> Batches:
        """Rows with a checksum are whole windows, rows with ids are rests, and the last one has the ids' document
        frequencies in this partition.  ``unit`` is a number of its own for each window and rest."""
        codec = encoder(vocabulary)
        size = len(codec.ending)
        frequency = np.zeros(size + 1, np.int64)  # the last counts documents
        unit = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = with_end(*codec.encode([t or "" for t in part.column("text").to_pylist()]), end)
                owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
                keys, times = np.unique(owner * np.uint64(size) + ids, return_counts=True)
                frequency[:size] += np.bincount((keys % np.uint64(size)).astype(np.int64), minlength=size)
                frequency[size] += len(first) - 1
                places = [p.tolist() for p in topics.value.places(keys, times)] if topics else [[0] * (len(first) - 1)] * 2
                rows = []
                for doc_id, a, b, *place in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), *places, strict=True):
                    cut = a + (b - a) // window * window
                    for at in range(a, cut, window):
                        rows.append((doc_id, at - a, b - a, unit, _crc(ids[at : at + window]), None, None, None, None))
                        unit += 1
                    if cut < b:
                        rows.append((doc_id, cut - a, b - a, unit, None, ids[cut:b].astype("<u4").tobytes(), None, *place))
                        unit += 1
                yield _batch(rows)
        yield _batch([(None, None, None, None, None, None, frequency.tobytes(), None, None)])

    return work


def _frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents that hold each id, and at the end the number of documents: bounded by the vocabulary."""

    def spread(batches: Batches) -> Batches:
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                counts = np.frombuffer(raw, np.int64)
                kept = np.append(np.flatnonzero(counts[:-1]), len(counts) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts[kept])], names=["id", "n"])

    rows = encoded.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long")
    found = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["id"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    out[at] = n
    return out


class ShardIndex:
    """The inverted index of a shard: for each id, the rests that hold it and their BM25 weights."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray):
        lengths = np.array([len(r) for r in rests], np.int64)
        ids = np.concatenate(rests).astype(np.uint64) if rests else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(rests), dtype=np.uint64), lengths)
        keys = np.sort(ids << np.uint64(32) | owner)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        self.rest = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.id = (keys >> np.uint64(32)).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if len(lengths) else 1, 1))
        self.weight = idf[self.id] * times * (K1 + 1) / (times + norm[self.rest])
        self.begin = np.searchsorted(self.id, np.arange(len(idf) + 1))
        self.size = len(rests)
        # each rest's query: the ids with the largest weights in it
        order = np.lexsort((self.id, -self.weight, self.rest))
        bounds = np.searchsorted(self.rest[order], np.arange(self.size + 1))
        self.queries = [self.id[order[a : min(b, a + QUERY_TERMS)]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def scores(self, rest: int) -> np.ndarray:
        terms = self.queries[rest]
        runs = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        found = np.concatenate([self.rest[r] for r in runs]) if runs else np.empty(0, np.int64)
        weight = np.concatenate([self.weight[r] for r in runs]) if runs else np.empty(0)
        return np.bincount(found, weights=weight, minlength=self.size)


def fill_windows(rests: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (rest, start, length), each id of each rest in one of them, all windows but the last one full."""
    index = ShardIndex(rests, idf)
    left = np.array([len(r) for r in rests], np.int64)
    used = np.zeros(len(rests), np.int64)
    seeds = iter(np.argsort(-left, kind="stable").tolist())
    windows = []

    def next_seed() -> int | None:
        return next((s for s in seeds if left[s]), None)

    seed = next_seed()
    while seed is not None:
        placed: list[tuple[int, int, int]] = []
        space = window

        def put(rest: int, most: int) -> int:
            length = int(min(most, left[rest]))
            placed.append((rest, int(used[rest]), length))  # noqa: B023
            used[rest] += length
            left[rest] -= length
            return length

        space -= put(seed, space)
        scores = index.scores(seed)
        scores[left == 0] = 0
        while space:
            near = np.flatnonzero(scores > 0)
            if len(near) > NEIGHBOURS:
                near = near[np.argpartition(-scores[near], NEIGHBOURS)[:NEIGHBOURS]]
            near = near[np.lexsort((near, -scores[near]))]
            scores[near] = 0
            rest_of = [n for n in near.tolist() if left[n]]
            tight = []
            for n in rest_of:
                if left[n] <= space:
                    space -= put(n, space)
                else:
                    tight.append(n)
                if not space:
                    break
            if space and tight:  # the best that does not fit gives its beginning
                space -= put(tight[0], space)
            elif space and not len(near):
                other = seed if left[seed] else next_seed()
                if other is None:
                    break
                seed = other
                space -= put(other, space)
        windows.append(placed)
        if not left[seed]:
            seed = next_seed()
    return windows


def _pack(frequency, window: int):
    def work(group: pa.Table) -> pa.Table:
        counts = frequency.value
        size, docs = len(counts) - 1, counts[-1]
        idf = np.log1p((docs - counts[:size] + 0.5) / (counts[:size] + 0.5))
        group = group.sort_by("unit")
        rests = [np.frombuffer(raw, "<u4") for raw in group["ids"].to_pylist()]
        ids, starts, tokens = (group[c].to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        shard = group["shard"][0].as_py()
        rows = []
        for nth, placed in enumerate(fill_windows(rests, idf, window)):
            offset = 0
            for rest, start, length in placed:
                crc = _crc(rests[rest][start : start + length])
                rows.append((ids[rest], starts[rest] + start, length, crc, tokens[rest], 2 * (shard << 32 | nth), offset))
                offset += length
        columns = list(zip(*rows, strict=True)) or [()] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return work


def _dealt(rests: DataFrame) -> DataFrame:
    """Rests with their shard, a stretch of the order by leaf and grain.

    A rest counts by its length and the mean one, so that neither the rests nor the ids of a shard are more than twice the
    mean.  What has the same leaf and grain lies over as many shards as it fills, however many copies there are.
    """
    length = F.col("doc_tokens") - F.col("start")
    keys = rests.groupBy("leaf", "grain").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length")).toArrow().sort_by([("leaf", "ascending"), ("grain", "ascending")])
    n, ids = keys["n"].to_numpy(), keys["length"].to_numpy()
    shards = pieces(int(n.sum()), SHARD_RESTS, most=1 << 30)
    if shards == 1:
        return rests.withColumn("shard", F.lit(0).cast("long"))
    mean = -(-int(ids.sum()) // int(n.sum()))
    spans = ids + n * mean
    stretch = -(-int(spans.sum()) // shards)
    columns = [keys["leaf"], keys["grain"], pa.array(np.cumsum(spans) - spans), pa.array(spans)]
    found = rests.sparkSession.createDataFrame(pa.table(columns, names=["leaf", "grain", "before", "span"]))  # 256 rows a leaf at most
    place = F.col("before") + F.pmod(F.xxhash64("unit"), F.col("span"))
    return rests.join(F.broadcast(found), ["leaf", "grain"]).withColumn("shard", F.floor(place / F.lit(stretch)).cast("long"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW) -> DataFrame:
    """The columns of ``PIECES`` for every piece: where its ids begin in its document, and its sequence and place in it.

    Null texts count as empty, that is, as the end id alone.  Repeated rows are packed each.  Other columns are left out.
    Sequences are numbered apart, not one after the other: whole windows have odd numbers, those of shards even ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, topics = rows.count(), None
    if total > SHARD_RESTS:
        topics = docs.sparkSession.sparkContext.broadcast(_topics(rows, total, vocabulary, end, window))  # bounded by the sample
    encoded = materialise(rows.mapInArrow(_encode(vocabulary, end, window, topics), _ENCODED), "encoded")
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(encoded))
    whole = encoded.where("ids_crc32 is not null").select(
        "doc_id", "start", F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (2 * F.col("unit") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    dealt = _dealt(encoded.where("ids is not null")).select("shard", "doc_id", "start", "doc_tokens", "unit", "ids")
    return whole.unionByName(dealt.groupBy("shard").applyInArrow(_pack(frequency, window), PIECES))
