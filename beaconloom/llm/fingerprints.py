"""Document fingerprints: SimHash over weighted terms, and a search with permuted block tables.

* **Fingerprint.**  The terms of a document are its pairs of neighbouring words, weighted by how often they occur.  Each term's
  hash votes with its weight on every bit, for 1 where its bit is set and against it where not.  The share of equal bits
  of two fingerprints tells the angle between the weighted term vectors.
* **Search.**  Bits are cut into blocks, more than half as many as the radius has bits.  Two fingerprints within the radius then
  differ in at most one bit of some block, so one table for each block, with this block permuted to the front as the key, finds
  them all: a query asks it for its own key and for those with one bit flipped.  A pair that meets in several tables is taken
  from the first of them alone.  Tables hold a row for each block, queries one for each bit and block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import SLICE_BYTES, Batches, bit_votes, in_order, joined, mixed, packed_bits, per_text, span_hashes, word_spans
from beaconloom.operators.lookups import lookup_join
from beaconloom.session import materialise

BITS = 128
#: One changed word of 250 turns 5 bits (median), two turn 7, five of 1,000 turn 6.
RADIUS = 9
BLOCK_BITS = 32
#: Documents whose doc_id this number divides are the queries of a search against all documents.
QUERY_EVERY = 20


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's pairs of neighbouring words, repeats included, and where each text's begin.

    A text of one word has that word as its term, one without a word but not empty all its bytes, an empty one none.
    """
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    first = per_text(starts, offsets)
    count = np.diff(first)
    filled = np.flatnonzero((count == 0) & (np.diff(offsets) > 0))
    whole = span_hashes(data, offsets[filled], offsets[filled + 1], fold=False) if len(filled) else np.empty(0, np.uint64)
    terms = np.maximum(count - 1, np.diff(offsets) > 0)
    begin = np.zeros(len(terms) + 1, np.int64)
    np.cumsum(terms, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    owner = np.repeat(np.arange(len(terms)), terms)
    at = first[owner] + np.arange(len(out)) - begin[owner]  # the first word of each term
    pair = count[owner] > 1
    with np.errstate(over="ignore"):
        left = words[at[pair]]
        out[pair] = mixed(left * np.uint64(0x9E3779B97F4A7C15) + words[at[pair] + 1])
        single = count[owner] == 1
        out[single] = words[at[single]]
        out[count[owner] == 0] = whole
    return out, begin


def fingerprints_of(texts: list[bytes], bits: int = BITS) -> np.ndarray:
    """(texts, bits / 64) words; equal texts have equal ones, and an empty text has no bit set."""
    data, offsets = joined(texts)
    terms, first = term_hashes(data, offsets)
    with np.errstate(over="ignore"):
        words = np.stack([mixed(terms + np.uint64(k) * np.uint64(0xD1B54A32D192ED03)) for k in range(bits // 64)], axis=1)
    votes = bit_votes(words, first)  # a term that occurs n times votes n times: that is its weight
    return packed_bits(2 * votes > np.diff(first)[:, None])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1])


def hex_digits(codes: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in codes.astype(">u8")]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters from the beginning of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Each text but the last against its edited text and the next one."""
    own = fingerprints_of([t.encode() for t in texts])
    changed = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
    other = fingerprints_of(changed)
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
        pa.array(hex_digits(own[:-1])),
        pa.array(hex_digits(other)),
        pa.array(likeness(own[:-1], other)),
        pa.array(likeness(own[:-1], own[1:])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _compared(batches: Batches) -> Batches:
    """Walks through a partition with one row carried over, so that each row meets the next one."""
    ids: list = []
    texts: list[str] = []
    size, block = 0, None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True)
        for at, doc_id, text in rows:
            if at != block and block is not None:
                if len(ids) > 1:
                    yield _compare(ids, texts)
                ids, texts, size = [], [], 0
            block = at
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size > SLICE_BYTES and len(ids) > 1:
                yield _compare(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0])
    if len(ids) > 1:
        yield _compare(ids, texts)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for every row; other columns are left out.

    The next document is that with the next larger doc_id, after the last the first (the same one if it is alone); rows
    without an id come before all others.  Null text counts as empty.  Repeated rows stay repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_order(rows, ["doc_id", "text"], halo=True).mapInArrow(_compared, SCHEMA)


def _cuts(bits: int, radius: int) -> list[tuple[int, int]]:
    """Where blocks begin and end: so many that one of them differs in one bit at most, of ``BLOCK_BITS`` at most."""
    count = max(radius // 2 + 1, -(-bits // BLOCK_BITS))
    cuts = [round(i * bits / count) for i in range(count + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _block(words: list[Column], begin: int, end: int) -> Column:
    """The bits from ``begin`` to ``end`` of 64-bit words, the first bit being the highest of the first word."""
    first, last = begin // 64, (end - 1) // 64
    value = F.shiftrightunsigned(words[last], 64 * (last + 1) - end)
    if first < last:
        value = value.bitwiseOR(F.shiftleft(words[first], end - 64 * last))
    return value.bitwiseAND(F.lit((1 << end - begin) - 1).cast("long"))


def _words(name: str, bits: int) -> list[Column]:
    return [F.conv(F.substring(name, 16 * k + 1, 16), 16, -10).cast("long") for k in range(bits // 64)]


def _digits(words: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def within_radius(queries: DataFrame, codes: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """For every fingerprint of ``queries``, the ones of ``codes`` that differ in at most ``radius`` bits, itself included:
    fingerprint, found, distance.  Both sides should hold each fingerprint once."""
    cuts, count = _cuts(bits, radius), bits // 64
    slack = radius // len(cuts)  # 0 or 1

    def tables(df: DataFrame, side: str, flips: bool) -> DataFrame:
        """A row for each table and key; the table's number stands above the bits of its block."""
        named = df.select(*[w.alias(f"_{side}{k}") for k, w in enumerate(_words("fingerprint", bits))])
        keys = []
        for number, (begin, end) in enumerate(cuts):
            own = _block([F.col(f"_{side}{k}") for k in range(count)], begin, end)
            own = own.bitwiseOR(F.lit(number << BLOCK_BITS).cast("long"))
            masks = [0, *[1 << i for i in range(end - begin)]] if flips else [0]
            keys += [own.bitwiseXOR(F.lit(mask).cast("long")) for mask in masks]
        return named.select("*", F.explode(F.array(*keys)).alias(f"_{side}key"))

    left, right = tables(queries, "a", slack > 0), tables(codes, "b", False)
    apart = [F.col(f"_a{k}").bitwiseXOR(F.col(f"_b{k}")) for k in range(count)]
    distance = sum((F.bit_count(x) for x in apart), F.lit(0))
    # from the first table in which the two meet
    number = F.shiftright("_akey", BLOCK_BITS)
    earlier = F.lit(False)
    for k, (begin, end) in enumerate(cuts[:-1]):
        earlier = earlier | ((number > k) & (F.bit_count(_block(apart, begin, end)) <= slack))
    # Never broadcast: the estimate of a side leaves out that each of its rows becomes one for every key.
    pairs = left.hint("merge").join(right.hint("merge"), (F.col("_akey") == F.col("_bkey")) & (distance <= radius) & ~earlier)
    sides = [_digits([F.col(f"_{side}{k}") for k in range(count)]) for side in "ab"]
    return pairs.select(sides[0].alias("fingerprint"), sides[1].alias("found"), distance.alias("distance"))


def with_neighbours(compared: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """Adds n_near: for documents whose doc_id is divisible by ``every``, how many others lie within the radius; else null.

    ``compared`` should be a written table.  Copies are counted, not paired: each distinct fingerprint is searched once.
    """
    codes = compared.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = F.col("doc_id") % every == 0
    queries = compared.where(asked).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    sizes = codes.select(F.col("fingerprint").alias("found"), F.col("n").alias("size"))
    near = within_radius(queries.select("fingerprint"), codes.select("fingerprint"), radius)
    counted = near.join(sizes, "found").groupBy("fingerprint").agg(F.sum("size").alias("near"))
    known = materialise(queries.join(counted, "fingerprint"), "near")
    found = lookup_join(compared, known, "fingerprint", spread_by="doc_id", broadcast_bytes=16 << 20)
    return found.select(*compared.columns, F.when(asked, F.col("near") - 1).alias("n_near"))
