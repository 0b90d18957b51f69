"""Approximate nearest neighbours with a hierarchical k-means tree.

A tree of centroids is fitted on a bounded sample and every vector is put into the leaf that it comes down to.  A query goes
through the tree best bin first: a priority queue holds all branches seen so far by the distance of their centroid, the
nearest one is opened next, and a leaf that comes up is visited.  How many leaves are visited is calibrated: a sample of
vectors has its neighbours found by brute force over all rows, and visits are widened until the tree finds the wanted share
of them.

Neighbouring leaves share a cell of a bounded number of vectors, and a leaf with more is spread over several, so that a vector
that fills a third of the table is no hot group.  A query goes once to each cell that holds leaves it visits.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches, mixed
from beaconloom.session import materialise

#: The sample that the tree is fitted on: rows, and numbers in all, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 8_000_000
BRANCHES, ROUNDS = 16, 10
#: Vectors in a leaf, at about; sampled vectors in a leaf, at least; vectors in a cell, at about.
LEAF_ROWS, LEAF_SAMPLE, CELL_ROWS = 128, 8, 8192
#: Vectors that calibrate the number of visits, and the share of their neighbours that is to be found.
CALIBRATORS, RECALL = 200, 0.97
NEAREST = 10
QUERY_EVERY = 100


@dataclass
class Tree:
    """Nodes by number: their centroid, and their children or their leaf."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray | None] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centroid: np.ndarray) -> int:
        self.centroids.append(centroid)
        self.children.append(None)
        self.leaf.append(-1)
        return len(self.centroids) - 1

    def seal(self) -> None:
        self.table = np.array(self.centroids)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector comes down to, by the nearest centroid on each level."""
        out = np.empty(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            below = self.children[node]
            if below is None:
                out[rows] = self.leaf[node]
                continue
            choice = squares(vectors[rows], self.table[below]).argmin(axis=1)
            stack += [(int(below[c]), rows[choice == c]) for c in np.unique(choice)]
        return out

    def best_bins(self, query: np.ndarray):
        """The leaves, nearest branch first."""
        heap: list[tuple[float, int]] = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            below = self.children[node]
            if below is None:
                yield self.leaf[node]
                continue
            for value, child in zip(((self.table[below] - query) ** 2).sum(axis=1).tolist(), below.tolist(), strict=True):
                heapq.heappush(heap, (value, child))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, but for rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _clusters(points: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    centers = points[rng.choice(len(points), count, replace=False)]
    for _ in range(ROUNDS):
        own = squares(points, centers).argmin(axis=1)
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return squares(points, centers).argmin(axis=1)


def fit_tree(points: np.ndarray, leaves: int, seed: int = 1) -> Tree:
    """A tree of about so many leaves over sampled vectors."""
    rng, tree = np.random.default_rng(seed), Tree()
    most = max(LEAF_SAMPLE, -(-len(points) // max(leaves, 1)))
    stack = [(tree.add(points.mean(axis=0)), np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        own = points[rows]
        count = min(BRANCHES, -(-len(rows) // most))
        groups = []
        if count > 1:
            choice = _clusters(own, count, rng)
            groups = [rows[choice == c] for c in np.unique(choice)]
        if len(groups) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        below = [tree.add(points[g].mean(axis=0)) for g in groups]
        tree.children[node] = np.array(below)
        stack += list(zip(below, groups, strict=True))
    tree.seal()
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, as doubles, of the vectors that take part: none that is null, zero, or holds a null or a
    number that is not finite, nor any of another length than most of them have."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    return good.where(F.size("embedding") == (top[0]["size"] if top else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rough: np.ndarray, count: int):
    """ids and exact distances of the nearest vectors, ties to the smaller id; ``rough`` are squares with rounding."""
    if len(ids) > count:
        edge = np.partition(rough, count - 1)[count - 1]
        slack = 1e-9 * (1 + edge + 2 * (query * query).sum())
        close = np.flatnonzero(rough <= edge + slack)
    else:
        close = np.arange(len(ids))
    exact = np.sqrt(((vectors[close] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[close], exact))[:count]
    return ids[close][order], exact[order], close[order]


def _sample(rows: DataFrame, total: int, count: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the rows with the smallest hashes: so many at most."""
    key = F.xxhash64("vec_id", F.lit(salt))
    few = rows.where(F.pmod(key, F.lit(max(total, 1))) < 2 * count)
    found = few.orderBy(F.xxhash64("vec_id", F.lit(-salt)), "vec_id").limit(count).toArrow()
    return found["vec_id"].to_numpy(), matrix(found["embedding"])


class Index:
    """A tree, the table of vectors with their leaves, and what was calibrated."""

    def __init__(self, vectors: DataFrame, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, count: int = NEAREST):
        self.spark, self.count = vectors.sparkSession, count
        rows = usable(vectors)
        self.total = rows.count()
        first = rows.select(F.size("embedding").alias("n")).head()
        self.width = first["n"] if first else 0
        if not self.total:
            return
        _, points = _sample(rows, self.total, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(self.width, 1)), 1)
        self.tree = fit_tree(points, -(-self.total // leaf_rows))
        sent = self.spark.sparkContext.broadcast(self.tree)  # bounded by the sample

        def place(batches: Batches) -> Batches:
            for batch in batches:
                leaf = sent.value.leaf_of(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

        self.rows = materialise(rows.mapInArrow(place, "leaf int, vec_id long, embedding array<double>"), "leaves")
        sizes = self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each leaf
        self.sizes = np.zeros(self.tree.leaves, np.int64)
        for row in sizes:
            self.sizes[row["leaf"]] = row["n"]
        self.visits, self.measured = self._calibrate(recall)

    def _calibrate(self, recall: float) -> tuple[int, float]:
        """The fewest leaves to visit that reach the recall on the calibrating vectors, and what they reach."""
        ids, queries = _sample(self.rows.select("vec_id", "embedding"), self.total, CALIBRATORS, 2)
        count = self.count

        def scan(batches: Batches) -> Batches:
            for batch in batches:
                own, leaf = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("leaf").to_numpy(zero_copy_only=False)
                vectors = matrix(batch.column("embedding"))
                rough = squares(queries, vectors)
                for q in range(len(queries)):
                    rough[q, own == ids[q]] = np.inf
                    found, distance, at = nearest(queries[q], vectors, own, rough[q], count)
                    other = found != ids[q]
                    columns = [np.full(other.sum(), q, np.int32), found[other], distance[other], leaf[at[other]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "score", "leaf"])

        found = self.rows.mapInArrow(scan, "query int, vec_id long, score double, leaf int")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        truth = found.withColumn("rank", rank).where(F.col("rank") <= count).groupBy("query").agg(F.collect_list("leaf").alias("leaves")).collect()
        need: list[int] = []  # for each true neighbour, how many leaves must be visited
        for row in truth:  # as many rows as calibrating vectors
            order = {leaf: nth for nth, leaf in enumerate(self.tree.best_bins(queries[row["query"]]), 1)}
            need += [order[leaf] for leaf in row["leaves"]]
        if not need:
            return 1, 1.0
        need.sort()
        visits = need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]
        return visits, float(np.mean(np.array(need) <= visits))

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id and score of the nearest vectors of each query, itself left out.

        ``queries`` has vec_id and embedding.  Queries with the same vector are searched once.  At least the calibrated
        number of leaves is visited, and more until they hold enough vectors.
        """
        if not self.total:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding")
        different = asked.groupBy("embedding").agg(F.min("query_id").alias("query"))
        tree, sizes, visits, count = self.tree, self.sizes, self.visits, self.count + 1
        before = np.cumsum(sizes) - sizes
        first, last = before // CELL_ROWS, np.maximum(before + sizes - 1, before) // CELL_ROWS
        sent = self.spark.sparkContext.broadcast((tree, sizes, before, first, last))  # as many numbers as leaves

        def route(batches: Batches) -> Batches:
            tree, sizes, _, first, last = sent.value
            for batch in batches:
                for nth, (query, vector) in enumerate(zip(batch.column("query").to_pylist(), matrix(batch.column("embedding")), strict=True)):
                    held, cells = 0, {}
                    for seen, leaf in enumerate(tree.best_bins(vector), 1):
                        held += int(sizes[leaf])
                        if sizes[leaf]:
                            for c in range(int(first[leaf]), int(last[leaf]) + 1):
                                cells.setdefault(c, []).append(leaf)
                        if seen >= visits and held >= count:
                            break
                    copies = batch.column("embedding").slice(nth, 1).take(pa.array([0] * len(cells), pa.int32()))
                    columns = [pa.array(list(cells), pa.int64()), pa.array([query] * len(cells), pa.int64()), copies]
                    columns.append(pa.array(list(cells.values()), pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "query", "embedding", "leaves"])

        def cell(batches: Batches) -> Batches:
            _, sizes, before, _, _ = sent.value
            for batch in batches:
                leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
                place = mixed(batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.uint64)) % sizes[leaf].astype(np.uint64)
                at = (before[leaf] + place.astype(np.int64)) // CELL_ROWS
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["cell", *batch.schema.names])

        def meet(members: pa.Table, asking: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[], [], []]
            if members.num_rows and asking.num_rows:
                vectors, ids, leaf = matrix(members["embedding"]), members["vec_id"].to_numpy(), members["leaf"].to_numpy()
                wanted, names, visited = matrix(asking["embedding"]), asking["query"].to_numpy(), asking["leaves"].to_pylist()
                order = np.argsort(leaf, kind="stable")
                vectors, ids, leaf = vectors[order], ids[order], leaf[order]
                for low in range(0, len(wanted), 256):
                    part = wanted[low : low + 256]
                    for q, rough in enumerate(squares(part, vectors)):
                        chosen = np.array(visited[low + q])
                        spans = zip(np.searchsorted(leaf, chosen), np.searchsorted(leaf, chosen, "right"), strict=True)
                        at = np.concatenate([np.arange(a, b) for a, b in spans])
                        found, distance, _ = nearest(part[q], vectors[at], ids[at], rough[at], count)
                        for to, values in zip(out, (np.full(len(found), names[low + q]), found, distance), strict=True):
                            to.append(values)
            joined = [np.concatenate(c) if c else np.empty(0) for c in out]
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            return pa.table({n: pa.array(c).cast(k) for n, c, k in zip(("query", "vec_id", "score"), joined, kinds, strict=True)})

        where = different.mapInArrow(route, "cell long, query long, embedding array<double>, leaves array<int>")
        there = self.rows.mapInArrow(cell, "cell long, leaf int, vec_id long, embedding array<double>")
        found = there.groupBy("cell").cogroup(where.groupBy("cell")).applyInArrow(meet, "query long, vec_id long, score double")
        best = Window.partitionBy("query").orderBy("score", "vec_id")
        short = found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= count).drop("_at")
        named = asked.join(different, "embedding").select("query_id", "query")
        own = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = named.join(short, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
        return ranked.where(F.col("rank") <= self.count).select("query_id", "rank", "vec_id", "score")
