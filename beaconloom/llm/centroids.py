"""Centroid clustering in whole numbers, with candidates filtered by an N-simplex projection.

* **Whole numbers.**  A component x counts as floor(64 * x).  Distances, sums and means are exact, so the result does not depend
  on how the rows are dealt.
* **Projection.**  Several pivots form a simplex.  A vector's distances to them, computed once and written with it, place it
  as the apex over that simplex: as many coordinates as there are pivots, the last one its height.  For two vectors the
  distance between their apexes is a lower bound of theirs, and the distance with one height turned over an upper bound.
* **Filter.**  In each round the centroids are projected as well.  For each vector only those stay whose lower bound is not
  above the least upper bound; they alone are compared, exactly.  Bounds are given room for rounding.
* **In Spark.**  A round is one pass over the written vectors.  Each task adds up its vectors of each centroid, so that a row for
  each centroid and component leaves it, however many vectors a centroid has.  The driver holds the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.llm.common import Batches
from beaconloom.llm.neighbours import matrix
from beaconloom.session import materialise

CENTROIDS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
PIVOTS = 8
#: A pivot stands at least this far off the simplex of those before it, as a share of its distance to the first.
LEAST_HEIGHT = 0.05
#: Room for rounding, as a share of the squared distances to the first pivot.
SLACK = 1e-3
#: The largest whole number of a component: with it every squared distance of two vectors fits into 64 bits.
LARGEST = 1 << 27
_ROWS = 8192


class Simplex:
    """Pivots among ``points`` that stand well apart, and the simplex they form."""

    def __init__(self, points: np.ndarray, count: int = PIVOTS):
        self.pivots = points[:1]
        #: Row i - 1 holds the i coordinates of pivot i; pivot 0 is the origin.
        self.base = np.zeros((0, 0))
        while 0 < len(self.pivots) < min(count, len(points)):
            apexes, first = self.apexes(points)
            height = np.where(apexes[:, -1] ** 2 > LEAST_HEIGHT**2 * first, apexes[:, -1], 0)
            best = int(height.argmax())
            if not height[best] > 0:
                break
            grown = np.zeros((len(self.base) + 1, len(self.base) + 1))
            grown[:-1, :-1] = self.base
            grown[-1] = apexes[best]
            self.base, self.pivots = grown, np.concatenate([self.pivots, points[best : best + 1]])

    def apexes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The apex of each vector, and its squared distance to the first pivot."""
        squared = np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(np.float64)
        first = squared[:, 0]
        flat = np.zeros((len(vectors), len(self.base)))
        if len(self.base):
            right = (first[:, None] + (self.base**2).sum(axis=1)[None] - squared[:, 1:]) / 2
            flat = np.linalg.solve(self.base, right.T).T
        height = np.sqrt(np.maximum(first - (flat**2).sum(axis=1), 0))
        return np.concatenate([flat, height[:, None]], axis=1), first


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances between all rows of ``a`` and all of ``b``, but for rounding."""
    apart = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1] - 1):
        apart += (a[:, axis, None] - b[None, :, axis]) ** 2
    up, down = a[:, -1, None], b[None, :, -1]
    return apart + (up - down) ** 2, apart + (up + down) ** 2


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each vector, ties to the smaller one; its squared distance; and how many
    pairs were compared."""
    near, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
    own, own_first = simplex.apexes(centroids)
    compared = 0
    for at in range(0, len(vectors), _ROWS):
        part, apex = vectors[at : at + _ROWS], apexes[at : at + _ROWS]
        low, high = bounds(apex, own)
        room = SLACK * ((apex**2).sum(axis=1)[:, None] + own_first[None, :] + 1)
        row, candidate = np.nonzero(low - room <= (high + room).min(axis=1)[:, None])
        exact = np.full((len(part), len(centroids)), np.iinfo(np.int64).max)
        for low_at in range(0, len(row), _ROWS):
            r, c = row[low_at : low_at + _ROWS], candidate[low_at : low_at + _ROWS]
            exact[r, c] = ((part[r] - centroids[c]) ** 2).sum(axis=1)
        compared += len(row)
        near[at : at + _ROWS] = exact.argmin(axis=1)  # the first of the least
        far[at : at + _ROWS] = exact.min(axis=1)
    return near, far, compared


def whole_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and components as whole numbers of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = rows.where((F.size("embedding") == width) & ~bad)
    large = F.exists("embedding", lambda v: F.abs(v) > LARGEST / SCALE)
    message = f"a vector has a component beyond {LARGEST // SCALE}: its squared distances do not fit into 64 bits"
    wholes = F.transform("embedding", lambda v: F.floor(v * SCALE).cast("int"))
    return good.select("vec_id", F.when(large, F.raise_error(F.lit(message))).otherwise(wholes).alias("whole"))


def first_centroids(rows: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors whose vec_id has the smallest hashes; those without an id come last, ties in order of components."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(F.asc_nulls_last(key), "whole").limit(count).collect()  # ``count`` rows at most
    return np.array([r["whole"] for r in found], np.int64)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, simplex: Simplex):
    vectors = matrix(batch.column("whole")).astype(np.int64)
    return vectors, nearest(vectors, matrix(batch.column("apex")), centroids, simplex)


def _moved(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round."""

    def add_up(batches: Batches) -> Batches:
        sums, sizes = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, (near, _, _) = _assigned(batch, centroids, simplex)
                np.add.at(sums, near, vectors)
                sizes += np.bincount(near, minlength=len(centroids))
        cluster, axis = np.divmod(np.arange(sums.size), centroids.shape[1])
        held = np.repeat(sizes, centroids.shape[1]) > 0
        columns = [cluster[held], axis[held], sums.ravel()[held], np.repeat(sizes, centroids.shape[1])[held]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "axis", "total", "n"])

    parts = rows.mapInArrow(add_up, "cluster long, axis long, total long, n long")
    total, n = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n"))
    out = centroids.copy()
    for row in parts.groupBy("cluster", "axis").agg(total, n).collect():  # a row for each centroid and component
        out[row["cluster"], row["axis"]] = int(row["total"]) // int(row["n"])
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors take part that have ``width`` components, none of them null, not a number or infinite; zero vectors do.
    Repeated rows and equal vectors stay, and each counts.  A row without vec_id takes part, but becomes a first centroid
    only if there are too few others.  With fewer vectors than centroids there are fewer centroids; without any there are no rows.
    A component beyond 2**21 is an error, as 64 bits do not hold its distances.  Other columns are left out.
    """
    result = "vec_id long, cluster int, distance long"
    whole = materialise(whole_vectors(vectors, width), "wholes")
    centroids = first_centroids(whole, count)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    simplex = Simplex(centroids, pivots)

    def project(batches: Batches) -> Batches:
        for batch in batches:
            apexes, _ = simplex.apexes(matrix(batch.column("whole")).astype(np.int64))
            flat = pa.array(apexes.ravel())
            starts = pa.array(np.arange(0, apexes.size + 1, apexes.shape[1]), pa.int32())
            column = pa.ListArray.from_arrays(starts, flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "apex"])

    rows = materialise(whole.mapInArrow(project, "vec_id long, whole array<int>, apex array<double>"), "apexes")
    for _ in range(rounds):
        centroids = _moved(rows, centroids, simplex)

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            _, (near, far, _) = _assigned(batch, centroids, simplex)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near), pa.array(far)], names=["vec_id", "cluster", "distance"])

    done = materialise(rows.mapInArrow(assign, result), "assigned")
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    facts = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(few), "cluster").select(*done.columns, "cluster_inertia", "inertia", "centroid_sha256")
