"""Stupid-backoff scores of documents under an n-gram model of all other documents.

A word's score after the two words a and b is ``c(a b w) / c(a b)``; if the three never occur, BACKOFF times that after b
alone, ``c(b w) / c(b)``; if those never do, BACKOFF again times the word's share of all words; a word that occurs nowhere
counts as half an occurrence.  The counts are those of the whole corpus less the document's own, so that no text vouches for
itself; its copies in other documents do.

The count tables are partitioned by the hash of the n-gram.  To keep rows few, n-grams travel packed: documents are dealt to
batches, and a batch sends each partition one row with its distinct n-grams there, sorted, and how often it has them.  A
partition adds these rows up to its count tables and joins each row to them, which is a merge of sorted columns; what goes
back is a row of counts in the same order.  The batch joins these to its n-grams, scores every word and sums by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import mixed, over_slices, per_text, pieces, slices, span_hashes, text_bytes, word_spans
from beaconloom.llm.word_ids import PART_BYTES

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a batch, at about.
BATCH_BYTES = 20 << 20

#: Bits of an n-gram's hash; n-grams with the same one share their counts.  At 30 GB about one n-gram in 1.5 billion does.
HASH_BITS = 64

_COUNTS = "words long, bytes long"


def packed(values: np.ndarray) -> bytes:
    """Numbers by their bytes, all lowest ones first, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values, values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind: type, count: int) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=count * width) if count else b"", np.uint8)
    return np.ascontiguousarray(data.reshape(width, count).T).view(kind).reshape(count)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers: small ones, that pack well."""
    return np.diff(values, prepend=values.dtype.type(0))


class Grams:
    """The n-grams of some texts.  Words are what lies between ASCII white space."""

    def __init__(self, texts: pa.Array, order: int = ORDER):
        data, offsets = text_bytes(texts)
        starts, ends = word_spans(data, offsets, PART_BYTES)
        self.first = per_text(starts, offsets)
        #: The text of each word, and for n = 1, 2, ... the n-gram that ends with it; those at a text's beginning are cut off.
        self.text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.place = np.arange(len(starts)) - self.first[self.text]
        self.hashes = [span_hashes(data, starts, ends, fold=False)]
        with np.errstate(over="ignore"):
            for n in range(2, order + 1):
                before = np.roll(self.hashes[-1], 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                self.hashes.append(mixed(before ^ self.hashes[0]))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that end an n-gram, and its hash."""
        at = np.flatnonzero(self.place >= n - 1)
        return at, self.hashes[n - 1][at] >> np.uint64(64 - HASH_BITS)


def _slices(batch: pa.Table):
    """Bounded parts of a batch, in order."""
    for part in batch.to_batches():
        yield from slices(part, "text")


def distinct(batch: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... the distinct n-grams of a batch, sorted, and how often each occurs."""
    every: list[list[np.ndarray]] = [[] for _ in range(order)]
    for part in _slices(batch):
        grams = Grams(part.column("text"), order)
        for n in range(order):
            every[n].append(grams.of(n + 1)[1])
    out = []
    for n in range(order):
        hashes = np.concatenate(every[n]) if every[n] else np.empty(0, np.uint64)
        every[n] = []
        hashes.sort()
        first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        out.append((hashes[first], np.diff(np.append(first, len(hashes)))))
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes in order have their buckets in order."""
    top = hashes >> np.uint64(HASH_BITS - 32) if HASH_BITS >= 32 else hashes << np.uint64(32 - HASH_BITS)
    return (top * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _requests(order: int, buckets: int):
    def work(batch: pa.Table) -> pa.Table:
        name, rows = batch["batch"][0].as_py(), []
        for n, (hashes, counts) in enumerate(distinct(batch, order), 1):
            cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
            for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    rows.append((bucket, name, n, b - a, packed(steps(hashes[a:b])), packed(counts[a:b].astype(np.uint32))))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        names = ["bucket", "batch", "n", "size", "hashes", "counts"]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})

    return work


def _answers(group: pa.Table) -> pa.Table:
    """The rows of a partition of the count tables, each with the corpus's counts instead of its batch's."""
    rows = group.select(["batch", "n", "size", "hashes", "counts"]).to_pylist()
    out = []
    for n in sorted({r["n"] for r in rows}):
        own = [r for r in rows if r["n"] == n]
        hashes = np.concatenate([np.cumsum(unpacked(r["hashes"], np.uint64, r["size"])) for r in own])
        counts = np.concatenate([unpacked(r["counts"], np.uint32, r["size"]) for r in own]).astype(np.int64)
        order = np.argsort(hashes)
        first = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        totals = np.add.reduceat(counts[order], np.flatnonzero(first))
        answer = np.empty_like(counts)
        answer[order] = totals[np.cumsum(first) - 1]
        stops = np.cumsum([r["size"] for r in own])
        out += [(r["batch"], n, group["bucket"][0].as_py(), r["size"], packed(answer[b - r["size"] : b])) for r, b in zip(own, stops, strict=True)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [()] * 5
    names = ["batch", "n", "bucket", "size", "counts"]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})


def _others(grams: Grams, n: int, known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each word, how often the n-gram that ends with it occurs outside its text; -1 if it has none.

    A stable sort by hash puts equal n-grams together and, as words are in order of texts, those of one text side by side.
    """
    out = np.full(len(grams.text), -1, np.int64)
    at, hashes = grams.of(n)
    if len(at):
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.diff(ranked, prepend=~ranked[:1]) != 0
        apart = new | (np.diff(grams.text[at[order]], prepend=-1) != 0)
        own = np.diff(np.append(np.flatnonzero(apart), len(order)))
        everywhere = totals[np.searchsorted(known, ranked[new])]
        out[at[order]] = everywhere[np.cumsum(new) - 1] - own[np.cumsum(apart) - 1]
    return out


def word_scores(grams: Grams, counts: list[tuple[np.ndarray, np.ndarray]], words: int) -> np.ndarray:
    """The natural logarithm of every word's score; ``counts`` are the sorted n-grams and what the corpus has of each."""
    order = len(counts)
    others = [_others(grams, n, *counts[n - 1]) for n in range(1, order + 1)]
    size = np.diff(grams.first)[grams.text]
    remaining = np.maximum(words - size, 1)
    score = np.log(np.maximum(others[0], 0.5)) - np.log(remaining)
    for n in range(2, order + 1):
        context = np.roll(others[n - 2], 1)
        seen = (others[n - 1] > 0) & (context > 0)  # a context that never occurs elsewhere: the n-gram shares its hash
        better = np.log(np.where(seen, others[n - 1], 1)) - np.log(np.where(seen, context, 1))
        has = grams.place >= n - 1
        score = np.where(seen, better, np.where(has, score + np.log(BACKOFF), score))
    return score


def _score(order: int, words: int):
    def work(batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
        counts = []
        for n, (hashes, _) in enumerate(distinct(batch, order), 1):
            parts = [unpacked(r["counts"], np.int64, r["size"]) for r in rows if r["n"] == n]
            counts.append((hashes, np.concatenate(parts) if parts else np.empty(0, np.int64)))
        sizes, sums = [], []
        for part in _slices(batch):
            grams = Grams(part.column("text"), order)
            sizes.append(np.diff(grams.first))
            sums.append(np.bincount(grams.text, weights=word_scores(grams, counts, words), minlength=part.num_rows))
        numbers = [pa.array(np.concatenate(x) if x else np.empty(0, k), k) for x, k in ((sizes, "int64"), (sums, "float64"))]
        return pa.table({"doc_id": batch["doc_id"], "n_words": numbers[0], "log_score": numbers[1]})

    return work


def _volume(docs: DataFrame) -> tuple[int, int]:
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array([len(word_spans(data, offsets, PART_BYTES)[0])]), pa.array([len(data)])], names=["words", "bytes"])

    total = docs.select("text").mapInArrow(over_slices(count), _COUNTS).agg(F.sum("words"), F.sum("bytes")).head()
    return int(total[0] or 0), int(total[1] or 0)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words and log_score (the sum over words) of every row; other columns are left out.

    Null, empty and blank texts have no words and score 0.  Repeated rows are documents of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words, volume = _volume(rows)
    batches = pieces(volume, BATCH_BYTES)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))
    dealt = dealt.repartition(batches, "batch")  # read twice, moved once
    requests = dealt.groupBy("batch").applyInArrow(
        _requests(order, batches), "bucket int, batch int, n int, size long, hashes binary, counts binary"
    )
    answers = requests.groupBy("bucket").applyInArrow(_answers, "batch int, n int, bucket int, size long, counts binary")
    return (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(_score(order, words), "doc_id long, n_words long, log_score double")
    )
