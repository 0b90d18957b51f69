"""Jaccard join of shingle sets with adaptive prefixes that must match several times.

* **Sets.**  A document's set holds the 64-bit hashes of its distinct word n-grams.  Equal sets are one class.
* **Order.**  All shingles are ordered by the number of documents that have them, rare ones first.  A shingle in one document only
  cannot be shared, so a set is carried on as its size and its shingles that others have too.
* **Prefixes.**  Two sets that reach the similarity share at least t = ceil(similarity * size) shingles, of either size.  Of the
  first size - t + l shingles of each, they then share at least l.  A longer prefix costs more list entries to read but lets
  fewer candidates through; each document takes the l of least estimated cost, from the lengths of its prefix's lists, and two
  documents are candidates if their prefixes share as many shingles as the smaller of their two l.
* **Verification.**  The shared shingles of candidates are counted exactly, unless the two are connected already.

In Spark: hashes travel packed, one row for each slice of text and bucket of shingles, to be counted, and only those that several
documents have travel back.  A shingle that several documents of a slice have is sent once for the slice.  Each shingle then names a
leader, the least of the sets with it in their prefix; sets that share a leader meet in one task, in blocks if they are many,
which returns a spanning forest of their links.  The forests are joined to components by repeated star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, mixed, per_text, pieces, slices, span_hashes, text_bytes, text_volume, word_spans
from beaconloom.llm.components import components
from beaconloom.llm.near_duplicates import unite
from beaconloom.operators.lookups import lookup_join
from beaconloom.session import materialise

WORDS, PERCENT = 4, 85
#: Prefixes are lengthened by this many shingles at most: each choice is right, and one further on would hardly be cheaper.
LONGEST = 12
#: Bytes of text whose shingles are counted by one task; sets that meet in one task; list entries expanded at a time.
BUCKET_BYTES, BLOCK_SETS, ENTRIES = 24 << 20, 2048, 1 << 21
#: Rows of a slice at most, so that a row's number fits into 16 bits; the number of a shingle that several rows have.
_SLICE_ROWS, _MANY = 60_000, 0xFFFF
#: Cost of counting one shingle of a candidate, where reading one list entry costs 1.
COUNTING = 0.25

_LOW = np.uint64((1 << 48) - 1)
_WORD_BYTES = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each text, and where each text's begin (one more entry)."""
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets, _WORD_BYTES)
    first = per_text(starts, offsets)
    count = np.diff(first)
    hashes = span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        run = mixed(hashes + np.uint64(words))
        for step in range(1, words):
            left = max(len(run) - step, 0)
            run[:left] = mixed(run[:left] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:])
    last = np.arange(len(hashes)) - first[text] + words <= count[text]
    keep, owner = run[last], text[last]
    short = np.flatnonzero((count > 0) & (count < words))
    whole = np.empty(len(short), np.uint64)
    for nth, i in enumerate(short.tolist()):  # fewer words: all of them, and their number
        value = np.uint64(count[i])
        with np.errstate(over="ignore"):
            for h in hashes[first[i] : first[i + 1]]:
                value = mixed(np.array([value * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
        whole[nth] = value
    every, of = np.concatenate([keep, whole]), np.concatenate([owner, short])
    order = np.lexsort((every, of))
    every, of = every[order], of[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (of[1:] != of[:-1])
    every, of = every[new], of[new]
    return every, np.searchsorted(of, np.arange(len(count) + 1))


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set; 0 for the empty set alone."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes))])
        keys = mixed((sums[first[1:]] - sums[first[:-1]]) ^ np.diff(first).astype(np.uint64))
    return np.where(np.diff(first) > 0, np.maximum(keys, np.uint64(1)), np.uint64(0))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper 16 bits, so that a bucket and the lower 48 bits make a shingle's number."""
    return ((hashes >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def _pack(hashes: np.ndarray) -> tuple[bytes, bytes]:
    return hashes.astype(np.uint32).tobytes(), (hashes >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)


#: ``place``: bucket; ``low`` and ``high``: the lower 48 bits of shingles; ``owner``: row in the slice, or ``_MANY``; ``n``: documents.
#: A slice's own row has ``ids``, set keys, sizes, and which rows have the shingles of ``_MANY``.
_SENT = "slice long, place int, own boolean, low binary, high binary, owner binary, n binary, ids array<long>, keys binary, sizes binary"
_SENT_NAMES = ["slice", "place", "own", "low", "high", "owner", "n", "ids", "keys", "sizes"]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SENT_NAMES)


def _small(batch: pa.RecordBatch):
    for part in slices(batch, "text"):
        for at in range(0, part.num_rows, _SLICE_ROWS):
            yield part.slice(at, _SLICE_ROWS)


def _send(words: int, buckets: int):
    def work(batches: Batches) -> Batches:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _small(batch):
                hashes, first = shingles(part.column("text"), words)
                sizes = np.diff(first)
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
                ids = part.column("doc_id").to_pylist()
                order = np.argsort(hashes, kind="stable")
                value, of = hashes[order], owner[order]
                new = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
                uses = np.diff(np.append(new, len(value)))
                shared = np.repeat(uses > 1, uses)
                distinct, holder = value[new], np.where(uses > 1, np.uint16(_MANY), of[new]).astype(np.uint16)
                place = _bucket(distinct, buckets)
                by_row = np.lexsort((holder, place))  # runs of one row compress well
                distinct, holder, uses, place = distinct[by_row], holder[by_row], uses[by_row], place[by_row]
                cuts = np.searchsorted(place, np.arange(buckets + 1))
                rows = []
                for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a < b:
                        several = uses[a:b][uses[a:b] > 1].astype(np.uint32).tobytes()
                        rows.append((name, bucket, False, *_pack(distinct[a:b]), holder[a:b].tobytes(), several, None, None, None))
                keys = set_keys(hashes, first).tobytes()
                many = value[shared].tobytes(), None, of[shared].tobytes(), None
                rows.append((name, name % buckets, True, *many, ids, keys, sizes.astype(np.uint32).tobytes()))
                yield _sent(rows)
                name += 1

    return work


def _count(batches: Batches) -> Batches:
    """The shingles of a bucket that several documents have, for each slice, with how many; rows of slices pass through."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    sent = [r for r in rows if not r["own"]]
    out = [tuple(r[c] for c in _SENT_NAMES) for r in rows if r["own"]]
    if sent:
        value = [_unpack(r["low"], r["high"]) for r in sent]
        holder = np.concatenate([np.frombuffer(r["owner"], np.uint16) for r in sent])
        weight = np.ones(len(holder), np.int64)
        weight[holder == _MANY] = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in sent])
        ends = np.cumsum([len(v) for v in value])
        value = np.concatenate(value)
        order = np.argsort(value, kind="stable")
        new = np.flatnonzero(np.diff(value[order], prepend=~value[order][:1]) != 0)
        total = np.add.reduceat(weight[order], new)
        n = np.empty(len(value), np.int64)
        n[order] = np.repeat(total, np.diff(np.append(new, len(value))))
        n = np.minimum(n, 0xFFFFFFFF).astype(np.uint32)
        for row, end, size in zip(sent, ends.tolist(), [len(r["owner"]) // 2 for r in sent], strict=True):
            part = slice(end - size, end)
            keep = n[part] > 1
            if keep.any():
                low, high = _pack(value[part][keep])
                out.append((row["slice"], row["place"], False, low, high, holder[part][keep].tobytes(), n[part][keep].tobytes(), None, None, None))
    yield _sent(out)


def required(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles a set shares with any that reaches the similarity."""
    return -(-percent * sizes.astype(np.int64) // 100)


def prefix_choice(size: int, n: np.ndarray, percent: int = PERCENT, longest: int = LONGEST) -> tuple[int, int]:
    """l and the number of shared shingles in the prefix, for a set of ``size`` whose shared shingles are in ``n``
    documents each, in order; (0, 0) if nothing can be similar to it."""
    least = int(required(np.array([size]), percent)[0])
    single = size - len(n)
    if size - least + 1 <= single:
        return 0, 0
    lengths = np.minimum(size - least + np.arange(1, min(longest, least) + 1) - single, len(n))
    entries = np.cumsum(n.astype(np.float64) - 1)[lengths - 1]
    steps = np.arange(1, len(lengths) + 1)
    # a candidate needs l of the entries read, so there are entries / l of them at most
    cost = entries + COUNTING * len(n) * entries / steps
    best = int(cost.argmin())
    return best + 1, int(lengths[best])


_PREFIXED = "kind int, doc_id long, set_key long, size int, least int, prefix int, numbers binary"
_PREFIXED_NAMES = ["kind", "doc_id", "set_key", "size", "least", "prefix", "numbers"]


def _prefixed(buckets: int, percent: int, longest: int):
    """For a slice: rows of kind 0, a document each; of kind 1, a set each that may be similar to another."""

    def work(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["own"])
        keys, sizes = np.frombuffer(own["keys"], np.int64), np.frombuffer(own["sizes"], np.uint32)
        numbers, counts, holders = [], [], []
        many, many_of = np.frombuffer(own["low"], np.uint64), np.frombuffer(own["owner"], np.uint16)
        many_number = many & _LOW | _bucket(many, buckets).astype(np.uint64) << np.uint64(48)
        for r in (r for r in rows if not r["own"]):
            number = _unpack(r["low"], r["high"]) | np.uint64(r["place"]) << np.uint64(48)
            n, of = np.frombuffer(r["n"], np.uint32), np.frombuffer(r["owner"], np.uint16)
            single = of != _MANY
            numbers.append(number[single])
            counts.append(n[single])
            holders.append(of[single])
            if not single.all():  # shingles of several rows of this slice: one entry for each of them
                known, n_known = number[~single], n[~single]
                by = np.argsort(known)
                a = np.searchsorted(known[by], many_number)
                hit = (a < len(known)) & (known[by][np.minimum(a, len(known) - 1)] == many_number)
                numbers.append(many_number[hit])
                counts.append(n_known[by][a[hit]])
                holders.append(many_of[hit])
        out: list[tuple] = [(0, i, k, s, 0, 0, None) for i, k, s in zip(own["ids"], keys.tolist(), sizes.tolist(), strict=True)]
        if numbers:
            number, n, of = np.concatenate(numbers), np.concatenate(counts), np.concatenate(holders)
            order = np.lexsort((number, n, of))
            number, n, of = number[order], n[order], of[order]
            seen = set()
            cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
            for i in np.unique(of).tolist():
                key, part = int(keys[i]), slice(cuts[i], cuts[i + 1])
                if key not in seen:
                    seen.add(key)
                    least, prefix = prefix_choice(int(sizes[i]), n[part], percent, longest)
                    if prefix:
                        out.append((1, None, key, int(sizes[i]), least, prefix, number[part].tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table({c: pa.array(v, k) for c, v, k in zip(_PREFIXED_NAMES, columns, kinds, strict=True)})

    return work


def _postings(batches: Batches) -> Batches:
    for batch in batches:
        for key, prefix, numbers in zip(*(batch.column(c).to_pylist() for c in ("set_key", "prefix", "numbers")), strict=True):
            number = np.frombuffer(numbers, np.int64)[:prefix]
            columns = [pa.array(number), pa.array(np.full(len(number), key, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "set_key"])


class Sets:
    """Sets that meet in a task: their shared shingles, renumbered in the order of all, and the lists of their prefixes."""

    def __init__(self, sizes: np.ndarray, least: np.ndarray, prefix: np.ndarray, numbers: list[np.ndarray]):
        self.sizes, self.least, self.prefix = sizes.astype(np.int64), least.astype(np.int64), prefix.astype(np.int64)
        count = np.array([len(x) for x in numbers], np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)])
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        names, self.token = np.unique(every, return_inverse=True)
        of = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(every)) - self.first[of] < self.prefix[of]
        order = np.argsort(self.token[inside], kind="stable")
        self.lists, listed = of[inside][order], self.token[inside][order]
        self.list_first = np.searchsorted(listed, np.arange(len(names) + 1))
        #: (set, shingle) of every shared shingle as one number, in order.
        self.width = max(len(names), 1)
        self.members = np.sort(of * self.width + self.token)

    def candidates(self, percent: int):
        """Pairs (a, b), a > b, whose prefixes share enough shingles and whose sizes allow the similarity, in blocks of a."""
        total = len(self.sizes)
        reach = np.diff(self.list_first)
        at = 0
        while at < total:
            to, entries = at, 0
            while to < total and (to == at or entries < ENTRIES) and to - at < ENTRIES // max(total, 1) + 1:
                entries += int(reach[self.token[self.first[to] : self.first[to] + self.prefix[to]]].sum())
                to += 1
            counts = np.zeros((to - at) * total, np.int32)
            for a in range(at, to):
                token = self.token[self.first[a] : self.first[a] + self.prefix[a]]
                length = reach[token]
                step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                other = self.lists[np.repeat(self.list_first[token], length) + step]
                counts[(a - at) * total : (a - at + 1) * total] = np.bincount(other, minlength=total)
            hit = np.flatnonzero(counts)
            a, b = hit // total + at, hit % total
            small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
            good = (a > b) & (counts[hit] >= np.minimum(self.least[a], self.least[b])) & (100 * small >= percent * large)
            yield a[good], b[good]
            at = to

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles a[i] and b[i] share."""
        length = self.first[a + 1] - self.first[a]
        of = np.repeat(np.arange(len(a)), length)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        wanted = b[of] * self.width + self.token[self.first[a][of] + step]
        place = np.minimum(np.searchsorted(self.members, wanted), len(self.members) - 1)
        return np.bincount(of, self.members[place] == wanted, minlength=len(a)).astype(np.int64)

    def forest(self, percent: int) -> np.ndarray:
        """The root of each set's tree."""
        parent = np.arange(len(self.sizes))
        for a, b in self.candidates(percent):
            length = np.concatenate([[0], np.cumsum(np.diff(self.first)[a])])
            at = 0
            while at < len(a):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                to = max(at + 1, int(np.searchsorted(length, length[at] + ENTRIES // 8)))
                x, y = a[at:to], b[at:to]
                at = to
                apart = parent[x] != parent[y]
                x, y = x[apart], y[apart]
                if len(x):
                    both = self.shared(x, y)
                    good = 100 * both >= percent * (self.sizes[x] + self.sizes[y] - both)
                    unite(parent, x[good], y[good])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        return parent


def _meet(percent: int):
    def work(group: pa.Table) -> pa.Table:
        keys = group["set_key"].to_numpy()
        numbers = [np.frombuffer(x, np.int64) for x in group["numbers"].to_pylist()]
        sets = Sets(group["size"].to_numpy(), group["least"].to_numpy(), group["prefix"].to_numpy(), numbers)
        root = sets.forest(percent)
        linked = root != np.arange(len(root))
        return pa.table({"a": keys[linked], "b": keys[root[linked]]})

    return work


def _places(met: DataFrame, block: int) -> DataFrame:
    """In which tasks each set is compared: (task, set_key).

    Leaders with few sets share a task by hash; the sets of a leader with more than ``block`` are dealt to blocks, and
    each two blocks meet in a task.
    """
    sizes = met.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    few = met.join(sizes.where(F.col("n") <= block), "leader")
    tasks = pieces(met.count(), block)
    shared = few.select(F.concat(F.lit("s"), F.pmod(F.xxhash64("leader"), F.lit(tasks))).alias("task"), "set_key").distinct()
    blocks = F.ceil(F.col("n") / block).cast("int")
    many = met.join(sizes.where(F.col("n") > block), "leader").select("leader", "set_key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    dealt = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws("/", F.lit("m"), "leader", F.least("own", "other"), F.greatest("own", "other"))
    return shared.unionByName(dealt.select(pair.alias("task"), "set_key"))


def links(prefixed: DataFrame, percent: int = PERCENT, block: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b) between sets, such that the same ones hang together as if all similar pairs were linked.

    ``prefixed`` has a row for each set and should be a written table.
    """
    entries = materialise(prefixed.select("set_key", "prefix", "numbers").mapInArrow(_postings, "number long, set_key long"), "postings")
    # of a shingle that a third of all sets have, each task passes on one row
    by_hash = F.min(F.struct(F.xxhash64("set_key"), "set_key"))["set_key"]
    leaders = entries.groupBy("number").agg(by_hash.alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialise(entries.join(leaders, "number").select("leader", "set_key").distinct(), "met")
    placed = _places(met, block).join(prefixed, "set_key")
    return placed.groupBy("task").applyInArrow(_meet(percent), "a long, b long")


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, longest: int = LONGEST, block: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; other columns are left out.

    Two documents are linked if ``percent`` of the shingles that either has are in both; component_id is the smallest doc_id
    that links reach, null only where no reachable row has one.  A null text, or one without words, has no shingles and
    is linked with nothing, not with its like either.  Rows with the same doc_id are linked only if their texts are
    similar.  Repeated rows stay repeated.  ``docs`` should be a written table: a task that runs again must meet its rows in the
    same order, as a row goes by its number in a slice.  Shingles are told apart by 64 bits of hash (by 48 and the bucket when they are
    counted), sets by 64.
    """
    buckets = pieces(text_volume(docs), BUCKET_BYTES, most=1 << 16)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(_send(words, buckets), _SENT)
    counted = sent.repartitionById(buckets, F.col("place")).mapInArrow(_count, _SENT)  # a task for each bucket
    work = _prefixed(buckets, percent, longest)
    done = materialise(counted.groupBy("slice").applyInArrow(work, _PREFIXED), "prefixed")
    each = done.where("kind = 0").select("doc_id", F.col("set_key").alias("node"), F.col("size").cast("long").alias("n_shingles"))
    prefixed = materialise(done.where("kind = 1").select(*_PREFIXED_NAMES[2:]).dropDuplicates(["set_key"]), "sets")
    member = components(links(prefixed, percent, block))
    classes = each.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = classes.join(member, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # documents that are like no other need no lookup
    linked = rooted.join(least, "root").where((F.col("n") > 1) | ~F.col("component_id").eqNullSafe(F.col("first")))
    known = materialise(linked.select(F.col("node").cast("string").alias("node"), "component_id", "n"), "members")
    keyed = each.select("doc_id", "n_shingles", F.when(F.col("node") != 0, F.col("node").cast("string")).alias("node"))
    found = lookup_join(keyed, known, "node", spread_by="doc_id", broadcast_bytes=16 << 20)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
