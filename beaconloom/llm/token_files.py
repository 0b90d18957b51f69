"""Token ids in files that answer questions while compressed: one wavelet matrix for each shard.

A wavelet matrix of 16-bit ids has 16 planes of bits.  The first holds the highest bit of every id; the ids with a 0 there are
then moved before those with a 1, in order, and the next plane holds the next bit of each; and so on.  With the number of
set bits before every 512th place, one id, the number of times an id occurs before a place, and the place of its n-th
occurrence are each found with two looks at every plane.

A shard is the row of a Parquet table: its documents in ascending doc_id, and one payload.  Little-endian layout:

    magic 4 bytes, version u16, planes u16, ids u64, then for each plane: zeros u64, bytes of bits u32, bytes of ranks u32,
    then each plane's bits and ranks (u32 for every 512 bits), each compressed with zstandard.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconloom.llm.common import SLICE_BYTES, Batches, in_order
from beaconloom.llm.word_ids import encoder, with_end

MAGIC, VERSION = b"WVMX", 1
#: Ids in a shard; a document is never cut, so the last one of a shard may go beyond.
SHARD_IDS = 1 << 19
RANK_BITS = 512
_HEAD, _PLANE = struct.Struct("<4sHHQ"), struct.Struct("<QII")


def _divided(values: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values whose bit is 0, and those whose bit is 1, in order."""
    size = len(values)
    column = pa.Array.from_buffers(pa.from_numpy_dtype(values.dtype), size, [None, pa.py_buffer(values)])
    parts = []
    for bits in (~packed, packed):
        mask = pa.Array.from_buffers(pa.bool_(), size, [None, pa.py_buffer(bits)])
        parts.append(column.filter(mask).to_numpy())
    return parts[0], parts[1]


def pack_shard(ids: np.ndarray) -> bytes:
    """The payload of a shard."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    planes = max(16, int(ids.max()).bit_length()) if len(ids) else 16
    values = np.ascontiguousarray(ids, np.uint16 if planes == 16 else np.uint32)
    heads, bodies = [], []
    for plane in range(planes - 1, -1, -1):
        packed = np.packbits((values >> values.dtype.type(plane)) & values.dtype.type(1), bitorder="little")
        zeros, ones = _divided(values, packed)
        bits, ranks = compress(packed.tobytes()), compress(_ranks(packed).tobytes())
        heads.append(_PLANE.pack(len(zeros), len(bits), len(ranks)))
        bodies += [bits, ranks]
        values = np.concatenate([zeros, ones])
    return b"".join([_HEAD.pack(MAGIC, VERSION, planes, len(ids)), *heads, *bodies])


def _ranks(packed: np.ndarray) -> np.ndarray:
    """Set bits before every ``RANK_BITS``-th place."""
    step = RANK_BITS // 8
    padded = np.concatenate([packed, np.zeros(-len(packed) % step, np.uint8)])
    each = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(each)]).astype(np.uint32)


class WaveletShard:
    """The ids of one payload.  Planes are decompressed when first needed."""

    def __init__(self, payload: bytes):
        magic, version, self.planes, self.size = _HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        self.payload = payload
        at = _HEAD.size + self.planes * _PLANE.size
        self.zeros, self.places = [], []
        for k in range(self.planes):
            zeros, bits, ranks = _PLANE.unpack_from(payload, _HEAD.size + k * _PLANE.size)
            self.zeros.append(zeros)
            self.places.append((at, bits, ranks))
            at += bits + ranks
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            import zstandard

            at, bits, ranks = self.places[k]
            expand = zstandard.ZstdDecompressor().decompress
            self._open[k] = (
                np.frombuffer(expand(self.payload[at : at + bits]) if self.size else b"", np.uint8),
                np.frombuffer(expand(self.payload[at + bits : at + bits + ranks]), np.uint32),
            )
        return self._open[k]

    def _bit(self, k: int, at: int) -> int:
        return int(self._plane(k)[0][at >> 3] >> (at & 7)) & 1

    def _ones(self, k: int, at: int) -> int:
        """Set bits of a plane before a place."""
        bits, ranks = self._plane(k)
        block = at // RANK_BITS
        low, full = block * RANK_BITS // 8, at >> 3
        count = int(ranks[block]) + int(np.bitwise_count(bits[low:full]).sum())
        return count + ((int(bits[full]) & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """The place of a plane's nth (from 0) bit of this value."""
        bits, ranks = self._plane(k)
        before = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, nth, "right")) - 1
        low = block * RANK_BITS
        part = np.unpackbits(bits[low >> 3 : (low + RANK_BITS) >> 3], bitorder="little")
        return low + int(np.flatnonzero(part == bit)[nth - before[block]])

    def __len__(self) -> int:
        return self.size

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for k in range(self.planes):
            bit, ones = self._bit(k, at), self._ones(k, at)
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """The run of places below the last plane that holds the occurrences of an id before ``end``."""
        low, high = 0, end
        for k in range(self.planes):
            a, b = self._ones(k, low), self._ones(k, high)
            if token >> (self.planes - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often an id occurs before a place."""
        if token < 0 or token >> self.planes:
            return 0
        low, high = self._range(token, min(max(end, 0), self.size))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of an id."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        at = self._range(token, self.size)[0] + nth
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]

    @cached_property
    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.planes == 16 else np.uint32
        values = np.zeros(self.size, kind)
        for k in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(self._plane(k)[0], count=self.size, bitorder="little").view(bool)
            values[self.zeros[k] :] |= kind(1 << (self.planes - 1 - k))
            above = np.empty_like(values)
            above[~bits], above[bits] = values[: self.zeros[k]], values[self.zeros[k] :]
            values = above
        return values


SCHEMA = "block int, shard int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _shards(vocabulary: str, end: int, shard_ids: int):
    def work(batches: Batches) -> Batches:
        """A partition's documents, in order, as shards."""
        codec = encoder(vocabulary)
        parts: list[np.ndarray] = []
        docs: list = []
        lengths: list[int] = []
        nth, size, block = 0, 0, 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            columns = [[block], [nth], [len(ids)], [docs], [lengths], [pack_shard(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["block", "shard", "n_ids", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            at, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            block = batch.column("block")[0].as_py() if len(batch) else block
            low = 0
            while low < len(texts):
                high, volume = low, 0
                while high < len(texts) and (high == low or volume + len(texts[high]) <= SLICE_BYTES):
                    volume += len(texts[high])
                    high += 1
                ids, first = with_end(*codec.encode(texts[low:high]), end)
                for i in range(high - low):
                    parts.append(ids[first[i] : first[i + 1]])
                    docs.append(at[low + i])
                    lengths.append(int(first[i + 1] - first[i]))
                    size += lengths[-1]
                    if size >= shard_ids:
                        yield shard()
                        parts, docs, lengths, size, nth = [], [], [], 0, nth + 1
                low = high
        if docs:
            yield shard()

    return work


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text (null: empty), appends the id ``end``, and writes the shards below ``path``.

    A row is a shard: ``block`` and ``shard`` give its place in ascending doc_id (rows without an id first, rows with the
    same id in the order of their text's hash), ``doc_ids`` and ``lengths`` its documents, ``payload`` the wavelet matrix.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = in_order(rows, ["doc_id", "text"])
    ordered.mapInArrow(_shards(vocabulary, end, shard_ids), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a table of token files, with ``start``: the ids in all shards before each."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.groupBy("block").agg(F.sum("n_ids").alias("ids"))
    blocks = sizes.select("block", (F.sum("ids").over(Window.orderBy("block")) - F.col("ids")).alias("before"))
    inside = Window.partitionBy("block").orderBy("shard")
    starts = shards.select("block", "shard", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("offset"))
    # as many rows as partitions were written, and as shards: numbers alone
    places = starts.join(F.broadcast(blocks), "block").select("block", "shard", (F.col("before") + F.col("offset")).alias("start"))
    return shards.join(places, ["block", "shard"])


def _digests(batches: Batches) -> Batches:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], np.int64)
            stops = np.cumsum(lengths)
            raw = memoryview(np.ascontiguousarray(WaveletShard(row["payload"]).ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + stops - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in shards that were read back."""
    rows = shards.select("start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Where an id occurs in the whole collection: a place for each, found in the compressed shards."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                found = WaveletShard(row["payload"]).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + x for x in found], pa.int64())], names=["place"])

    return shards.select("start", "payload").mapInArrow(work, "place long")
