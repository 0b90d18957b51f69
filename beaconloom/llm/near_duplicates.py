"""Near duplicates by SimHash, found with a hierarchical index in Gray order.

* **Fingerprints.**  Every run of three words is hashed (XXH64, seed 42); a bit of the fingerprint is 1 if it is set in more
  than half of the hashes.
* **Index.**  Distinct fingerprints are sorted by Gray rank, the place of a code in the order in which neighbours differ by
  one bit, so that neighbours share most bits.  The bits that all codes of a run share are factored out into a node above
  them, those that all nodes of a run share into one above these, and so on.  A search goes down from the top and adds up
  the bits in which the query differs from each node's own pattern; once that exceeds the distance, everything below is
  pruned at once.
* **In Spark.**  Ranges of ranks are the partitions.  Their shared patterns, a pair of numbers for each partition, are the top
  of the tree; every fingerprint is sent to the partitions that the top cannot prune, and each builds and searches its own
  part of the tree.  A partition returns a spanning forest of the links that it found, and the forests are joined to
  components by repeated star contraction.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import bit_votes, block_bounds, over_slices, packed_bits, pieces
from beaconloom.llm.components import components
from beaconloom.operators.lookups import lookup_join
from beaconloom.session import materialise

WORDS = 3
DISTANCE = 2
SEED = 42
#: Nodes or codes under one node; distinct fingerprints in one range of ranks, at about.
FAN = 16
RANGE_ROWS = 1 << 17
LEAST_RANGES = 12
#: Queries that go down the tree together.
BLOCK = 1024

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)


def shingle_hashes(text: bytes, size: int = WORDS) -> list[int]:
    """XXH64 of every run of ``size`` words, of all words if there are fewer; ASCII capitals as small letters."""
    import xxhash

    words = text.lower().split()  # of bytes: both know ASCII only, white space being 0x20 and 0x09 to 0x0D
    if not words:
        return []
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]  # noqa: B905
    return list(map(xxhash.xxh64_intdigest, runs, repeat(SEED)))


def fingerprints_of(texts: list[bytes], size: int = WORDS) -> np.ndarray:
    hashes = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(h) for h in hashes], out=first[1:])
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    votes = bit_votes(every[:, None], first)
    return packed_bits(2 * votes > np.diff(first)[:, None])[:, 0]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over elements in Gray order.  An element is a code, or a set of codes given by the AND and the OR of them."""

    def __init__(self, both: np.ndarray, either: np.ndarray):
        levels = [(both, either)]
        starts: list[np.ndarray] = []
        while len(levels[-1][0]) > FAN:
            low, high = levels[-1]
            at = np.arange(0, len(low), FAN)
            starts.append(at)
            levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)))
        #: From the top: pattern, its bits, its bits that no node above has, and where the next level's children begin and end.
        self.levels = []
        above = None
        for depth in range(len(levels) - 1, -1, -1):
            low, high = levels[depth]
            shared = low | ~high
            own = shared if above is None else shared & ~np.repeat(above, FAN)[: len(shared)]
            first = starts[depth - 1] if depth else np.empty(0, np.int64)
            last = np.append(first[1:], len(levels[depth - 1][0])) if depth else first
            self.levels.append((low, own, first, last))
            above = shared

    def search(self, queries: np.ndarray, distance: int):
        """Pairs (query, element) that may be, and for single codes are, within the distance; in blocks of queries."""
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            width = len(self.levels[0][0])
            query = np.repeat(np.arange(len(block)), width)
            node = np.tile(np.arange(width), len(block))
            differ = np.zeros(len(query), np.uint8)
            for depth, (pattern, own, _, _) in enumerate(self.levels):
                if depth:
                    _, _, first, last = self.levels[depth - 1]
                    count = last[node] - first[node]
                    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    query, differ, node = np.repeat(query, count), np.repeat(differ, count), np.repeat(first[node], count) + offset
                differ = differ + np.bitwise_count((block[query] ^ pattern[node]) & own[node])
                keep = differ <= distance
                query, node, differ = query[keep], node[keep], differ[keep]
            yield query + at, node


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = parent[nodes]
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; the root is the smallest node."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _forest(distance: int):
    def work(group: pa.Table) -> pa.Table:
        codes = group["fingerprint"].to_numpy().view(np.uint64)
        guests = group["guest"].to_numpy()
        own = codes[~guests]
        own = own[np.argsort(gray_rank(own))]
        every = np.concatenate([own, codes[guests]])
        parent = np.arange(len(every))
        if len(own):
            for query, element in GrayIndex(own, own).search(every, distance):
                new = query > element  # each pair of the range's own once, and no code with itself
                unite(parent, query[new], element[new])
        root = _roots(parent, np.arange(len(every)))
        linked = root != np.arange(len(every))
        signed = every.view(np.int64)
        return pa.table({"a": signed[linked], "b": signed[root[linked]]})

    return work


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, such that the same ones hang together as if all pairs within the
    distance were linked.  ``codes`` has a row for each fingerprint and its Gray rank, and should be a written table."""
    ranges = pieces(codes.count(), RANGE_ROWS, LEAST_RANGES)
    bounds = block_bounds(codes, "rank", ranges)
    edges = np.array(bounds, np.int64)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        return batch.column("fingerprint").to_numpy(zero_copy_only=False), np.searchsorted(edges, rank, "right").astype(np.int32)

    def place(batches):
        for batch in batches:
            code, at = placed(batch)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(code)], names=["at", "fingerprint"])

    tops = (
        codes.mapInArrow(place, "at int, fingerprint long")
        .groupBy("at")
        .agg(F.bit_and("fingerprint").alias("both"), F.bit_or("fingerprint").alias("either"))
        .orderBy("at")
        .collect()  # a row for each range
    )
    at_of = np.array([r["at"] for r in tops], np.int32)
    both = np.array([r["both"] for r in tops], np.int64).view(np.uint64)
    either = np.array([r["either"] for r in tops], np.int64).view(np.uint64)

    def route(batches):
        top = GrayIndex(both, either)
        for batch in batches:
            code, home = placed(batch)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(code), pa.array(np.zeros(len(code), bool))], names=["at", "fingerprint", "guest"])
            for query, element in top.search(code.view(np.uint64), distance):
                later = at_of[element] > home[query]  # of two ranges, the later one compares
                columns = [pa.array(at_of[element[later]]), pa.array(code[query[later]]), pa.array(np.ones(later.sum(), bool))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "fingerprint", "guest"])

    routed = codes.mapInArrow(route, "at int, fingerprint long, guest boolean")
    return routed.groupBy("at").applyInArrow(_forest(distance), "a long, b long")


def fingerprint_documents(docs: DataFrame, words: int = WORDS, hashed: bool = False) -> DataFrame:
    """doc_id, fingerprint as a signed long, and its Gray rank moved so that signed order is its order; also ``text_hash`` if ``hashed``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = fingerprints_of([(t or "").encode() for t in batch.column("text").to_pylist()], words)
        rank = (gray_rank(codes) ^ _SIGN).view(np.int64)
        columns = [batch.column("doc_id"), pa.array(codes.view(np.int64)), pa.array(rank), *[batch.column(c) for c in more]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "rank", *more])

    more = ["text_hash"] if hashed else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({name: F.xxhash64("text") for name in more})
    return rows.mapInArrow(over_slices(work), ", ".join(["doc_id long, fingerprint long, rank long", *[f"{name} long" for name in more]]))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row; other columns are left out.

    Documents are linked if their fingerprints differ in ``distance`` bits at most, and component_id is the smallest doc_id
    that can be reached; null only where no reachable row has an id.  Null and empty texts, and those of white space, have
    fingerprint 0.  Repeated rows stay repeated.
    """
    done = materialise(fingerprint_documents(docs, words), "fingerprints")
    codes = materialise(
        done.groupBy("fingerprint", "rank").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "codes"
    )
    member = components(links(codes, distance))
    rooted = codes.join(member, codes["fingerprint"] == member["node"], "left").select(
        "fingerprint", "first", "n", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    known = materialise(rooted.join(firsts, "root").select(digits, "component_id", "n"), "members")
    found = lookup_join(done.select("doc_id", digits), known, "fingerprint", spread_by="doc_id", broadcast_bytes=16 << 20)
    return found.select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id; all columns stay.

    Of the rows of a group that share this doc_id, one with the least text hash stays; a row without a doc_id stays only where
    no row of its group has one.  Rows with the same doc_id but unlike texts are in different groups, and each group keeps one.
    """
    done = materialise(fingerprint_documents(docs, words, hashed=True), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    codes = materialise(done.groupBy("fingerprint", "rank").agg(least.alias("least")), "codes")
    member = components(links(codes, distance))
    rooted = codes.join(member, codes["fingerprint"] == member["node"], "left").select("least", F.coalesce("root", "fingerprint").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("least"))
    kept = materialise(first.select(F.col("least.doc_id").alias("_kept_id"), F.col("least.text_hash").alias("_kept_hash")), "kept")

    def stay(rows: DataFrame, hashed: Column) -> DataFrame:
        same = rows["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]) & (hashed == kept["_kept_hash"])
        # by a shuffle whatever the size: neither side is bounded
        return rows.join(kept.hint("shuffle_hash"), same, "left_semi")

    out = stay(docs, F.xxhash64(docs["text"].cast("string")))
    if stay(done, done["text_hash"]).count() > kept.count():  # rows with the same id and text
        out = out.dropDuplicates(["doc_id", "text"])
    return out
