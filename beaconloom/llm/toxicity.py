"""Toxic passages as maximum-scoring segments of token log-odds.

* **Token scores.**  For words, and their first 4 to 8 bytes, the labelled toxic and clean documents that hold them are
  counted (documents, so that one that repeats a word proves no more than another).  Each string's log-odds between the
  classes have a Dirichlet prior; a token gets the largest lower confidence bound among its strings, so that a rare word is
  judged by how it begins.  Ordinary words come out below zero.
* **Passages.**  All maximal scoring segments of a document are found in one pass.
* **Extreme values.**  The best segment of m random tokens follows ``P(S > x) = 1 - exp(-K m exp(-lambda x))``; lambda comes
  from the distribution of token scores in clean text, K from the best segments of clean documents.  A segment is
  significant if fewer than ``E_VALUE`` as good are expected in a clean document of that length.
* **Documents.**  The normalised score of the best segment, those of all significant ones, and the length are combined by a
  logistic curve, fitted on labelled documents that the counts don't come from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, held_out, mixed, over_slices, per_text, slices, span_hashes, text_bytes, word_spans
from beaconloom.session import materialise

#: The labelled sample: rows at most, those with the smallest hashed ids.  A quarter of it fits the curve.
SAMPLE_ROWS = 24_000
#: Counts are kept by hash; so many cells, of which the model keeps a number each.
CELLS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: Prior count of a string in either class: at least this, and its share of both classes times PRIOR.
LEAST_PRIOR = 0.5
PRIOR = 50.0
#: Standard errors taken off the log-odds; the score of a token that tells nothing.
ERRORS = 3.2
NEUTRAL = -0.7
E_VALUE = 0.05
#: Token scores are tallied in so many steps of this width from NEUTRAL on.
STEP, STEPS = 0.05, 256


@dataclass(frozen=True)
class Model:
    """What is learned.  Its size is bounded by ``CELLS``."""

    scores: np.ndarray
    rate: float  # lambda
    size: float  # K
    weights: tuple[float, ...]


def token_cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The cells of each token's strings, one row for the whole word and one for each length of prefix (-1: none)."""
    out = np.full((1 + len(PREFIXES), len(starts)), -1, np.int32)
    out[0] = (span_hashes(data, starts, ends) & np.uint64(CELLS - 1)).astype(np.int32)
    for row, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > size)
        at = starts[long]
        hashes = mixed(span_hashes(data, at, at + size) ^ np.uint64(size))
        out[row, long] = (hashes & np.uint64(CELLS - 1)).astype(np.int32)
    return out


def token_scores(scores: np.ndarray, cells: np.ndarray) -> np.ndarray:
    best = scores[cells[0]]
    for row in cells[1:]:
        np.maximum(best, np.where(row >= 0, scores[row], NEUTRAL), out=best)
    return best


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), from left to right, in linear time.

    A segment is maximal if none of its parts scores more and no larger segment has that property.  Neighbours of one
    sign are merged first, which changes nothing, as no maximal segment begins or ends inside such a run.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    bounds = np.concatenate([[0], edges, [len(scores)]])
    sums = np.add.reduceat(scores, bounds[:-1])
    found: list[tuple[int, int, float, float]] = []  # start, end, total before it, total with it
    total = 0.0
    links: list[int] = []  # for each of found, the nearest one to its left with a smaller total before it
    for start, end, value in zip(bounds[:-1].tolist(), bounds[1:].tolist(), sums.tolist(), strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        a, b, left, right = start, end, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = links[j]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right))
                links.append(j)
                break
            a, left = found[j][0], found[j][2]
            del found[j:], links[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def scored(model_scores: np.ndarray, texts: pa.Array):
    """For each text: its bytes, the spans of its tokens, their scores, and its segments."""
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets)
    scores = token_scores(model_scores, token_cells(data, starts, ends)).astype(np.float64)
    first = per_text(starts, offsets)
    for i in range(len(texts)):
        part = scores[first[i] : first[i + 1]]
        yield data, starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], maximal_segments(part)


def features(segments: list[tuple[int, int, float]], tokens: int, rate: float, size: float) -> list[float]:
    """1; and where there is a segment: 1 again, the best one's normalised score, the sum over significant ones, damped, and
    the document's length, damped.  All documents without a segment are alike."""
    if not segments:
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    offset = np.log(size * tokens)
    normal = [rate * s - offset for _, _, s in segments]
    strong = sum(x for x in normal if x > -np.log(E_VALUE))
    return [1.0, 1.0, float(np.clip(max(normal), -20, 20)), float(np.log1p(strong)), float(np.log1p(tokens))]


def _log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Lower confidence bounds of the log-odds with an informative Dirichlet prior."""
    prior = np.maximum(PRIOR * (toxic + clean) / (all_toxic + all_clean), LEAST_PRIOR)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (all_toxic + 2 * PRIOR - toxic)) - np.log(b / (all_clean + 2 * PRIOR - clean))
    return np.maximum(odds - ERRORS * np.sqrt(1 / a + 1 / b), NEUTRAL)


def solve_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of ``sum(weights * exp(rate * values)) = 1``, for weights that sum to 1 and a mean below 0."""
    if not (values > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    gap = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum() - 1)
    while gap(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if gap(middle) < 0 else (low, middle)
    return (low + high) / 2


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        change = np.linalg.solve(curve, slope)
        w -= change
        if np.abs(change).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents that may be learned from, written to the shared folder.

    A document labelled twice is toxic if one label says so; of several texts of one doc_id, the one with the least hash
    teaches.  The last column tells the part that fits the curve.
    """
    usable = (
        labels.where(~held_out() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    picked = (
        usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(usable.count(), 1))) < 2 * rows)  # few to sort
        .orderBy(F.xxhash64("doc_id"))
        .limit(rows)
        .withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialise(texts.join(F.broadcast(picked), "doc_id"), "toxic-sample")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("of")).head()
    if sizes["n"] != sizes["of"]:
        one = F.min(F.struct(F.xxhash64("text"), "text", "label", "fits")).alias("one")
        sample = materialise(sample.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.label", "one.fits"), "toxic-sample")
    return sample.select("text", "label", "fits")


def _count_cells(batches: Batches) -> Batches:
    """Documents by class and cell; cell -1 counts the documents."""
    counts = np.zeros((2, CELLS + 1), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends = word_spans(data, offsets)
            cells, first = token_cells(data, starts, ends), per_text(starts, offsets)
            for i, label in enumerate(part.column("label").to_pylist()):
                own = np.unique(cells[:, first[i] : first[i + 1]])
                counts[int(label > 0), own[own >= 0]] += 1
                counts[int(label > 0), CELLS] += 1
    for k in (0, 1):
        cell = np.flatnonzero(counts[k])
        arrays = [pa.array(np.full(len(cell), k, np.int32)), pa.array(np.where(cell == CELLS, -1, cell)), pa.array(counts[k][cell])]
        yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "cell", "n"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled sample; without labels of both kinds, one that gives every document the same score."""
    sample = labelled_sample(docs, labels)
    cells = sample.where(~F.col("fits")).mapInArrow(_count_cells, "toxic int, cell long, n long")
    counts = np.zeros((2, CELLS + 1))
    rows = cells.groupBy("toxic", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["toxic"].to_numpy(), rows["cell"].to_numpy()] = rows["n"].to_numpy()
    scores = np.full(CELLS, NEUTRAL)
    seen = np.flatnonzero(counts[1, :CELLS] > 0)
    scores[seen] = _log_odds(counts[1][seen], counts[0][seen], counts[1, -1], counts[0, -1])
    scores = scores.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        starts, ends = word_spans(data, offsets)
        values, first = token_scores(sent.value, token_cells(data, starts, ends)), per_text(starts, offsets)
        bins = np.clip(np.round((values - NEUTRAL) / STEP), 0, STEPS - 1).astype(np.int64)
        found = [maximal_segments(values[a:b].astype(np.float64)) for a, b in zip(first[:-1], first[1:], strict=True)]
        spread = [np.bincount(bins[a:b], minlength=STEPS).tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        arrays = [batch.column("label"), pa.array([[x for _, _, x in f] for f in found], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(spread, pa.list_(pa.int64()))], names=["label", "segments", "spread"])

    fitted = sample.where("fits").select("text", "label")
    rows = fitted.mapInArrow(over_slices(measure), "label int, segments array<double>, spread array<long>").collect()
    clean = [r for r in rows if r["label"] == 0]
    spread = np.sum([r["spread"] for r in clean], axis=0) if clean else np.zeros(STEPS)
    rate = solve_rate(NEUTRAL + STEP * np.arange(STEPS), spread / spread.sum()) if spread.sum() else 1.0
    best = [(sum(r["spread"]), max(r["segments"], default=0.0)) for r in clean]
    size = len(best) / max(sum(n * np.exp(-rate * s) for n, s in best), 1e-12) if spread.sum() else 1.0
    y = np.array([r["label"] > 0 for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(scores, rate, size, (0.0,) * 5)
    x = np.array([features([(0, 0, s) for s in r["segments"]], sum(r["spread"]), rate, size) for r in rows])
    return Model(scores, rate, size, tuple(logistic_fit(x, y).tolist()))


def probability(model: Model, segments: list[tuple[int, int, float]], tokens: int) -> float:
    value = float(np.dot(model.weights, features(segments, tokens, model.rate, model.size)))
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each significant passage: doc_id, its text, where its bytes begin, score, and the expected number."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = sent.value, []
        _, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for i, (data, starts, ends, segments) in enumerate(scored(model.scores, batch.column("text"))):
            for a, b, value in segments:
                expected = model.size * len(starts) * float(np.exp(-model.rate * value))
                if expected <= E_VALUE:
                    text = data[starts[a] : ends[b - 1]].tobytes().decode()
                    rows.append((ids[i], int(starts[a] - offsets[i]), text, value, expected))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "start", "passage", "score", "expected"]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over_slices(work), "doc_id long, start long, passage string, score double, expected double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row; other columns are left out.

    Texts that are null, empty or without a word have no segment and get the score of all documents without one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, scores, strong = sent.value, [], []
        for _, starts, _, segments in scored(model.scores, batch.column("text")):
            scores.append(probability(model, segments, len(starts)))
            least = np.log(model.size * max(len(starts), 1) / E_VALUE) / model.rate
            strong.append(sum(s >= least for _, _, s in segments))
        values = np.array(scores)
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(values)]
        columns += [pa.array((values >= 0.5).astype(np.int32)), pa.array(strong, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over_slices(work), "doc_id long, held_out boolean, score double, predicted int, n_passages int")


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score as a column of ``docs``, for filters that keep all other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        for part in slices(batch, "text"):
            for _, starts, _, segments in scored(sent.value.scores, part.column("text")):
                out.append(probability(sent.value, segments, len(starts)))
        return pd.Series(out, dtype="float64")

    return score(F.col("text").cast("string"))
