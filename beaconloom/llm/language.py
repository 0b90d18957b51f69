"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed against it from left to right into the
longest phrases that occur in the labelled text; a character that occurs nowhere is a phrase of its own.  A text of n bytes
that falls into c phrases costs about ``c * log2(N) / n`` bits a byte, N being the length of the labelled text, and the
language that needs the fewest bits wins.

The automata become one table of transitions: the next state, and how many phrases end.  Many texts are then parsed in
step, one byte of each at a time.  Texts are cut for that into runs of ``RUN`` bytes; each run begins a phrase, in every
language alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconloom.llm.common import held, held_out, joined, over_slices

#: The labelled sample: rows of each language at most, bytes of text from each row and of each language at most.
SAMPLE_ROWS = 400
ROW_BYTES = 4_000
LANGUAGE_BYTES = 48_000
#: Bytes of all automata's tables at most; with many languages each gets a shorter text.
TABLE_BYTES = 256 << 20
RUN = 1024
UNKNOWN = "und"

_SPACE = 0x20


def folded(text: str) -> bytes:
    """The letters of a text in lower case, with one space for whatever lies between words."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letters = _LETTERS[raw]
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first byte behind a word
    return np.where(letters, raw, _SPACE)[keep].astype(np.uint8).tobytes() if len(raw) else b""


_LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton that accepts every substring of ``text``; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


class CrossParser:
    """The tables of several languages.  ``samples`` are (language, folded text), in the order that settles ties."""

    def __init__(self, samples: Sequence[tuple[str, bytes]]):
        self.languages = [name for name, _ in samples]
        self.bits = np.array([np.log2(max(len(text), 2)) for _, text in samples])
        used = sorted(set(b"".join(text for _, text in samples)))
        self.width = len(used) + 1  # symbol 0: a byte that no sample has
        self.symbols = np.zeros(256, np.int32)
        self.symbols[used] = np.arange(1, len(used) + 1)
        tables, self.starts, base = [], [], 0
        for _, text in samples:
            automaton = suffix_automaton(text)
            own = np.zeros((len(automaton), self.width), np.int64)
            for state, arcs in enumerate(automaton):
                for symbol, to in arcs.items():
                    own[state, self.symbols[symbol]] = to
            # where the parse breaks, the symbol starts the next phrase; if it occurs nowhere, it is one by itself
            broken = own == 0
            ended = broken.astype(np.int64)
            ended[1:] += broken[0]
            target = np.where(broken, own[0][None, :], own)
            tables.append((((target + base) * self.width) * 4 + np.where(broken, ended, 0)).astype(np.int32))
            self.starts.append(base * self.width)
            base += len(automaton)
        if base * self.width * 4 >= 1 << 31:
            raise ValueError("the automata are too large for one table; use shorter samples")
        self.table = np.concatenate([t.ravel() for t in tables]) if tables else np.empty(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many phrases each text falls into, by language."""
        data, offsets = joined(texts)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.diff(offsets)
        runs = -(-sizes // RUN)
        if not self.languages or not runs.sum():
            return out
        owner = np.repeat(np.arange(len(texts)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = offsets[owner] + nth * RUN
        length = np.minimum(RUN, offsets[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        symbols = self.symbols[data]
        lanes = len(begin)
        state = np.repeat(np.array(self.starts, np.int32)[:, None], lanes, axis=1)
        count = np.zeros((len(self.languages), lanes), np.int32)
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for j, n in enumerate(alive.tolist()):
            found = self.table[state[:, :n] + symbols[begin[:n] + j]]
            count[:, :n] += found & 3
            state[:, :n] = found >> 2
        count += state != np.array(self.starts)[:, None]  # the phrase under way at the end of a run
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts)).astype(np.int64)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1: the weight of the winner against all others, from the
        bits that each language needs (at most 64 differing bits count, and fewer in short texts)."""
        clean = [folded(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
        size = np.array([len(t) for t in clean], np.float64)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.phrases(clean) * self.bits[None, :]
        best = bits.argmin(axis=1)  # ties: the first language
        apart = np.clip(bits - bits.min(axis=1, keepdims=True), 0, 64)
        score = 1 / np.exp2(-apart).sum(axis=1)
        known = size > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, score, 0.0)


def labelled_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """For every value of lang, folded text of documents that may be learned from: the rows with the smallest hashes.

    The sample is bounded by the constants above and by the number of languages.  Rows without text or lang teach nothing,
    repeated rows once.
    """
    may = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", "text")
    counts = may.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("_n"))  # a row for each language
    few = (  # some rows more than are needed of each language, by a second hash, so that no sort sees many
        may.join(F.broadcast(counts), "lang")
        .where(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.col("_n")) < 3 * SAMPLE_ROWS)
        .select("lang", "doc_id", F.substring("text", 1, ROW_BYTES).alias("text"))
        .distinct()
    )
    # the limit holds in each task before the shuffle, so no language is a large group
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    texts = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_ROWS)
    gathered: dict[str, list[tuple[int, str]]] = {}
    for row in texts.collect():
        gathered.setdefault(row["lang"], []).append((row["nth"], row["text"]))
    each = min(LANGUAGE_BYTES, TABLE_BYTES // (600 * max(1, len(gathered))))
    samples = []
    for name in sorted(gathered):
        whole = b" ".join(folded(text) for _, text in sorted(gathered[name]))
        if whole.strip():
            samples.append((name, whole[:each]))
    return samples


def _parser(samples: list[tuple[str, bytes]]) -> CrossParser:
    """The tables, built once in each worker process."""
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    return held(("languages", key), lambda: CrossParser(samples))


def identify(docs: DataFrame, samples: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; other columns are left out.

    Texts that are null or have no letter are ``und`` with score 0, as is every text when nothing could be learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = _parser(sent.value).classify(batch.column("text").to_pylist())
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(over_slices(work), "doc_id long, held_out boolean, lang_pred string, score double")


def language_column(docs: DataFrame, samples: list[tuple[str, bytes]]) -> Column:
    """The predicted language as a column of ``docs``, for filters that keep all other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf("string")
    def predicted(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        values = [t if isinstance(t, str) else None for t in texts]
        at = 0
        while at < len(values):
            size, to = 0, at
            while to < len(values) and (to == at or size + len(values[to] or "") <= 1 << 20):
                size += len(values[to] or "")
                to += 1
            out += _parser(sent.value).classify(values[at:to])[0]
            at = to
        return pd.Series(out, dtype="object")

    return predicted(F.col("text"))
