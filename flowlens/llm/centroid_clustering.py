"""Centroid clustering of integer vectors by scalar lookup tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .vectors import integer_vectors, matrix

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256.0
SPAN = 4096  # a dimension whose values span more is tabulated by its distinct values instead of by offset


class Tables:
    """Squared differences for each dimension, occurring value and centroid.

    A dimension's table is indexed by the value's offset and grows when a
    batch brings values beyond it; a dimension whose values spread over more
    than SPAN is tabulated anew for the distinct values of each batch, so the
    tables hold at most SPAN (or a batch's rows) times the centroids each.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)  # (k, dims)
        self.low = [0] * centroids.shape[1]
        self.table: list[np.ndarray | None] = [None] * centroids.shape[1]

    def rows(self, d: int, values: np.ndarray) -> np.ndarray:
        """Squared differences of one dimension's values to all centroids, gathered from its table."""
        low, high = int(values.min()), int(values.max())
        held = self.table[d]
        if held is None or low < self.low[d] or high >= self.low[d] + len(held):
            if held is not None:
                low, high = min(low, self.low[d]), max(high, self.low[d] + len(held) - 1)
            if high - low >= SPAN:
                distinct, at = np.unique(values, return_inverse=True)
                return self.squares(d, distinct)[at]
            self.low[d], self.table[d] = low, self.squares(d, np.arange(low, high + 1))
        return np.take(self.table[d], values - self.low[d], axis=0)

    def squares(self, d: int, values: np.ndarray) -> np.ndarray:
        diff = values.astype(np.int64)[:, None] - self.centroids[:, d]
        return diff * diff

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
        total = np.zeros((len(q), len(self.centroids)), np.int64)
        for d in range(q.shape[1]):
            total += self.rows(d, q[:, d])
        best = total.argmin(axis=1)
        return best, total[np.arange(len(q)), best]


def partial_sums(batches, centroids: np.ndarray):
    """One row for each centroid that a task assigns vectors to: (cluster, n, sums)."""
    tables, (k, dims) = Tables(centroids), centroids.shape
    n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

    def out():
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]),
                                           pa.FixedSizeListArray.from_arrays(pa.array(sums[at].ravel()), dims).cast(pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    for batch in small_batches(batches, 4096):
        q = matrix(batch.column("q"), dims)
        best, _ = tables.nearest(q)
        order = np.argsort(best, kind="stable")
        first = np.flatnonzero(np.diff(best[order], prepend=-1))
        sums[best[order][first]] += np.add.reduceat(q[order].astype(np.int64), first, axis=0)
        n += np.bincount(best, minlength=k)
        if n.max() > 1 << 33:  # sums of so many components of at most 2^27 still fit
            yield out()
            n[:], sums[:] = 0, 0
    if n.any():
        yield out()


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches):
        tables = Tables(centroids)
        for batch in small_batches(batches, 4096):
            best, distance = tables.nearest(matrix(batch.column("q"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    return vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    parts = vectors.select("q").mapInArrow(lambda b: partial_sums(b, centroids), "cluster int, n long, sums array<long>")
    total = (parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out = centroids.copy()
    for row in total.collect():  # one row a centroid and dimension
        out[row["cluster"], row["d"]] = int(row["s"]) // row["n"]
    return out


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = 2,
                      id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): vec_id, cluster, distance, cluster_inertia and inertia of every clustered vector, and the final centroids.

    Vectors of exactly ``dims`` components, none null or non-finite, become
    integers floor(scale * x); all other rows are left out.  The first
    centroids are the k vectors with the smallest SHA-256 of "seed:id" in
    that order (a null id comes last; rows of one id by their components).
    Each round assigns every vector to the nearest centroid (squared distance,
    ties to the smaller number) and moves each centroid that has vectors to
    the floor of their mean, exactly; then vectors are assigned once more.
    Repeated rows count as vectors; with fewer than k vectors there are fewer
    centroids; empty input gives an empty result.  Ids must be integers.

    Distances are sums of gathers from tables over dimension, occurring value
    and centroid, made once a round in each task.  Tasks emit one sum for
    each centroid, so a round shuffles k rows a task and the driver sees k
    centroids, whatever the number of vectors or the size of a cluster.
    """
    rows = stored(integer_vectors(vectors, id_col, vec_col, scale, dims), "integers")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "q").limit(k).select("q").collect()
    centroids = np.array([r[0] for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia"))), centroids
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    found = stored(assigned(rows, centroids), "assigned")
    per = [(r["cluster"], int(r["s"])) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]
    inertia = sum(s for _, s in per)
    sums = found.sparkSession.createDataFrame([(c, s, inertia) for c, s in per], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
