"""Centroid clustering of integer vectors, with lower bounds by Ptolemy's inequality.

For pivots p, s and points x, c of a Euclidean space
    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).
The pivots are some of the starting centroids, as far from one another as can
be; distances from every vector to the pivots are computed once and kept beside
the vector. In a round a task computes the centroids' few pivot distances and
so bounds all of a batch's distances from below, over all pairs of pivots. The
centroid with the smallest bound is checked first; only those whose bound isn't
above the best distance so far are checked too, by exact integer arithmetic. The
bounds are lowered by more than their rounding errors and a tie is never
pruned, so the assignment is that of a full search.

Each task sums the vectors of its partition by centroid and sends one row a
centroid; the driver holds the centroids only. Centroids move to the floor of
the exact mean.

Edge cases: a vector that isn't of ``DIM`` components, or has a null, NaN or
infinite one, or is null, is left out; a scaled component beyond 2^27 stops the
job, as distances could leave 64 bits; sums that don't fit a long are null;
repeated vectors and ids are rows of their own; equal hashes (repeated or null
ids; null counts as empty) start in the order of their vectors; with fewer
vectors than ``K`` all are centroids; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

K, ROUNDS, SCALE, DIM, PIVOTS = 16, 3, 64, 64, 6
LIMIT = 1 << 27
U = 2.0 ** -52  # twice the unit roundoff


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the rows that have a whole finite vector."""
    good = (f"size({vector}) = {dim} and forall({vector}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    whole = (f"transform({vector}, x -> if(abs(cast(x as double)) <= {LIMIT / scale}D, cast(floor({scale}D * cast(x as double)) as int), "
             f"cast(raise_error('a component beyond {LIMIT} / {scale}') as int)))")
    return rows.filter(good).select(F.col(key).cast("long").alias("vec_id"), F.expr(whole).alias("v"))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to ``c``."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def distant(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` distinct points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen = [0]
    near = squares(points, points[0])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(points, points[chosen[-1]]))
    return points[chosen]


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squares(v, p) for p in pivots], axis=1).astype(np.float64))


class Search:
    """Finds the nearest of ``centroids`` for batches of vectors with kept pivot distances."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.checked = centroids, 0
        self.far = pivot_distances(centroids, pivots)
        between = pivot_distances(pivots, pivots)
        self.pairs = [(a, b, between[a, b]) for a, b in combinations(range(len(pivots)), 2) if between[a, b] > 0]

    def bounds(self, kept: np.ndarray) -> np.ndarray:
        """Squares of lower bounds, vectors by centroids; never above the true square."""
        best = np.zeros((len(kept), len(self.centroids)))
        for a, b, apart in self.pairs:
            x, y = np.outer(kept[:, a], self.far[:, b]), np.outer(kept[:, b], self.far[:, a])
            # each distance is within 1 U of its true value, relatively, a product within 3 U
            np.maximum(best, (np.abs(x - y) - 8 * U * (x + y)) / apart, out=best)
        return best * best * (1 - 16 * U)

    def nearest(self, v: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, exact squared distance); of equal distances the smaller number."""
        low = self.bounds(kept)
        which = low.argmin(axis=1)
        best = squares(v, self.centroids[which])
        first = which.copy()
        self.checked += len(v)
        for c in range(len(self.centroids)):
            rows = np.flatnonzero((low[:, c] <= best.astype(np.float64) * (1 + U)) & (first != c))
            if len(rows):
                d = squares(v[rows], self.centroids[c])
                better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
                best[rows[better]], which[rows[better]] = d[better], c
                self.checked += len(rows)
        return which, best


def _matrix(column, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def _keep(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            near = pivot_distances(_matrix(batch.column(1), pivots.shape[1], np.int64), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * len(pivots)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "near"])

    return run


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        search = Search(centroids, pivots)
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), centroids.shape[1], np.int64)
            which, _ = search.nearest(v, _matrix(batch.column(1), len(pivots), np.float64))
            np.add.at(total, which, v)
            count += np.bincount(which, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]),
                                          pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        search = Search(centroids, pivots)
        for batch in batches:
            which, best = search.nearest(_matrix(batch.column(1), centroids.shape[1], np.int64), _matrix(batch.column(2), len(pivots), np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floors of the exact means of what is nearest to each centroid; a centroid with nothing stays."""
    parts = vectors.select("v", "near").mapInArrow(_sums(centroids, pivots), "cluster int, n long, total array<long>")
    sums = (parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect())  # centroids x components
    out = centroids.copy()
    for r in sums:
        out[r.cluster, r.i] = int(r.x) // r.n
    return out


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the centroids)."""
    whole = shared_table(integer_vectors(rows, dim=dim), "vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = whole.orderBy(name, "v").limit(k).collect()
    if not starts:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in starts], np.int64)
    apart = distant(centroids, pivots)
    vectors = shared_table(whole.mapInArrow(_keep(apart), "vec_id long, v array<int>, near array<double>"), "pivot-distances")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, apart)
    found = shared_table(vectors.mapInArrow(_assign(centroids, apart), "vec_id long, cluster int, distance long"), "assigned")
    return found, centroids


def clusters_report(rows: DataFrame, **options) -> DataFrame:
    """Every kept vector with its cluster, its distance, the inertias and a digest of its final centroid."""
    found, centroids = cluster(rows, **options)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}

    def long(x: int):
        return F.lit(x if x < 1 << 63 else None).cast("long")

    def of_cluster(values: dict, kind: str, make=F.lit):
        return F.coalesce(*[F.when(F.col("cluster") == c, make(x)) for c, x in values.items()], F.lit(None).cast(kind)).cast(kind)

    return found.select("vec_id", "cluster", "distance", of_cluster(sums, "long", long).alias("cluster_inertia"),
                        long(sum(sums.values())).alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"))
