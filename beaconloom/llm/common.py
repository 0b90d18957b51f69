"""What the operators share: tables, batches of text, hashes of words, blocks of consecutive documents."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.session import scratch_path

#: Bytes of text that are worked on at a time, unless one text is longer.
SLICE_BYTES = 2 << 20
#: Bytes of text in one block of consecutive documents, and the most blocks that are cut.
BLOCK_BYTES = 16 << 20
MOST_BLOCKS = 20_000

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_WINDOW = 1 << 18

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once in each application."""
    context = spark.sparkContext
    if not getattr(context, "_beaconloom_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(root)))
        target = context._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package") + ".zip")
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(packed.getvalue()))
        out.close()
        context.addPyFile(target.toString())
        context._beaconloom_shipped = True
    return spark


_held: tuple[object, object] = (None, None)


def held(key: object, build: Callable[[], object]):
    """What a worker process needs again and again, such as a vocabulary, built once.

    A process holds one such thing at a time: workers are used again by later jobs, which need another.
    """
    global _held
    if _held[0] != key:
        _held = (None, None)
        _held = (key, build())
    return _held[1]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from; those without an id are held out too."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def over_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` that applies ``work`` to bounded parts of each batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, column):
                yield work(part)

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column in one array, and where each begins; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, kind, len(column) + 1, column.offset * width).astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``text_bytes``, of a list."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, each to another one (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Letters and digits of ASCII, and every byte of other characters; capitals of ASCII as small letters.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
FOLDED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_FOLDED_VALUES = _BYTE_VALUES[FOLDED]
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _WINDOW + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if n > 16 * _WINDOW:  # a giant word: not worth keeping
            return out[0], out[1]
        _powers = out[0], out[1]
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``word`` bytes; none reaches over the end of a text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, ASCII letters without case if ``fold``."""
    values = _FOLDED_VALUES if fold else _BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _WINDOW, "right")))
            run = values[data[base : ends[to - 1]]]
            up, down = _powers_to(len(run) + 1)
            run *= up[: len(run)]
            sums = np.zeros(len(run) + 1, np.uint64)
            np.cumsum(run, out=sums[1:])
            a, b = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            at = to
    return mixed(out)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the spans of each text begin in the list of all spans; one more entry than texts."""
    return np.searchsorted(starts, offsets, "left")


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, for the sizes of partitions."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).head()["n"])


def pieces(volume: int, each: int, least: int = 1, most: int = MOST_BLOCKS) -> int:
    return max(least, min(most, -(-volume // each)))


def block_bounds(docs: DataFrame, key: str, blocks: int) -> list[int]:
    """Values of the long column ``key`` that cut the rows into about equal blocks; at most ``blocks`` - 1."""
    if blocks < 2:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx(key, shares, 20 * blocks).alias("at")).head()["at"]
    return sorted({int(x) for x in found or []})


def block_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds that are at most ``key``; 0 without a key."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(x).cast("long") for x in bounds]) if len(bounds) < 64 else None
    if edges is None:
        return _search_udf(bounds)(F.col(key))
    return F.coalesce(F.size(F.filter(edges, lambda x: x <= F.col(key))), F.lit(0))


def _search_udf(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), np.int32)
        out[known] = np.searchsorted(edges, keys[known].astype("int64").to_numpy(), "right")
        return pd.Series(out)

    return block


def bit_votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of rows, how often each bit is set.

    ``hashes`` is (rows, words) of 64 bits, ``first`` where each group begins, with one more entry; the result is
    (groups, 64 * words), bit 0 of word 0 first.  Rows are unpacked in bounded blocks.
    """
    width = hashes.shape[1] * 64
    out = np.zeros((len(first) - 1, width), np.int64)
    full = np.flatnonzero(np.diff(first))
    begin = first[full]
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), width // 8)
    for low in range(0, len(hashes), 1 << 16):
        high = min(len(hashes), low + (1 << 16))
        bits = np.unpackbits(raw[low:high], axis=1, bitorder="little")
        a = int(np.searchsorted(begin, low, "right")) - 1
        b = int(np.searchsorted(begin, high, "left"))
        cuts = np.maximum(begin[a:b], low) - low
        # runs of at most 255 rows are added as bytes, which is many times faster
        fine = np.unique(np.concatenate([cuts, np.arange(0, high - low, 255)]))
        sums = np.add.reduceat(bits, fine, axis=0, dtype=np.uint8).astype(np.int64)
        out[full[a:b]] += np.add.reduceat(sums, np.searchsorted(fine, cuts), axis=0)
    return out


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """(rows, 64 * words) of truth values as (rows, words) of 64 bits."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(len(bits), -1) if len(bits) else np.empty((0, bits.shape[1] // 64), np.uint64)


def in_order(docs: DataFrame, columns: list[str], text: str = "text", halo: bool = False) -> DataFrame:
    """Rows in ascending doc_id, dealt in consecutive blocks of about ``BLOCK_BYTES`` of text to as many partitions.

    The columns are ``block`` and ``columns``; with ``halo`` also ``ahead``: the last row of each block is then, with that
    flag, the first row of the next block that has rows, and after the last block the first row of all.  Rows without an
    id come first.  Rows with the same id are in the order of their text's hash.
    """
    blocks = pieces(text_volume(docs, text), BLOCK_BYTES)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("_key"), *columns)
    bounds = block_bounds(keyed.select("_key"), "_key", blocks)
    rows = keyed.withColumn("block", block_of("_key", bounds)).withColumn("ahead", F.lit(False))
    if halo:
        starts = keyed.select("_key").withColumn("block", block_of("_key", bounds)).groupBy("block").agg(F.min("_key").alias("at"))
        found = sorted((r["block"], r["at"]) for r in starts.collect())  # a row for each block
        if found:
            before = [b for b, _ in found[-1:] + found[:-1]]
            first = docs.sparkSession.createDataFrame(
                [(at, b) for (_, at), b in zip(found, before, strict=True)], "_key long, block int"
            )
            copies = keyed.join(F.broadcast(first), "_key").select("_key", *columns, "block", F.lit(True).alias("ahead"))
            rows = rows.unionByName(copies)
    order = ["block", "ahead", "_key", F.xxhash64(text)]
    placed = rows.repartitionById(len(bounds) + 1, F.col("block")).sortWithinPartitions(*order)
    return placed.select("block", *columns, *(["ahead"] if halo else []))
