"""Centroid clustering by a bisector tournament on integer vectors.

Whether a vector is nearer to one of two centroids is the sign of a linear form: with the normal 2 (b - a) and
the threshold |b|^2 - |a|^2, a is at least as near as b if normal * vector <= threshold. Normals and thresholds of
all pairs are computed once a round; a vector then finds its nearest centroid by k - 1 sign tests, each of which
takes one centroid out (zero keeps the smaller number), and only the distance to the winner is computed. All is
in whole numbers, so that results don't depend on the order of sums, on partitions or on tasks that run again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import discard, staged

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
# Components must stay within this, so that every form, square and distance fits 64 bits.
MOST = 1 << 26
# Vectors whose forms are computed at once.
PART = 1 << 14


class Tournament:
    """The sign tests of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids**2).sum(1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, of equally near ones the smallest."""
        best = np.zeros(len(vectors), dtype=np.int64)
        for other in range(1, len(self.centroids)):
            form = np.einsum("ij,ij->i", vectors, self.normals[best, other])
            best[form > self.thresholds[best, other]] = other
        return best

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Squared Euclidean distances to the named centroids."""
        apart = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", apart, apart)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as whole numbers; components out of the range raise an error."""

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(scale) * x.cast("double"))
        beyond = F.raise_error(F.lit(f"a vector component is beyond {MOST} after scaling"))
        return F.when(F.abs(F.lit(scale) * x.cast("double")) <= MOST, scaled).otherwise(beyond.cast("bigint")).cast("int")

    return F.transform(vector, whole)


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has that many components, none of them null or non-finite; false for a null vector."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~odd, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def starts(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hex sha256 of ``seed:id``, in that order; equal ids go by their components.

    A null id counts as an empty one. Fewer vectors than ``clusters`` give as many centroids as there are.
    """
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(named.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()  # `clusters` rows
    return np.array([r["v"] for r in first], dtype=np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the exact floor of the mean of each one's vectors; without vectors it stays."""
    test, k, width = Tournament(centroids), *centroids.shape

    def sums(batches):
        counts, totals = np.zeros(k, np.int64), np.zeros((k, width), dtype=object)
        for batch in batches:
            vectors = _matrix(batch.column(0))
            for at in range(0, len(vectors), PART):
                part = vectors[at : at + PART]
                nearest = test.nearest(part)
                counts += np.bincount(nearest, minlength=k)
                own = np.zeros((k, width), np.int64)  # within a part sums fit 64 bits
                np.add.at(own, nearest, part)
                totals += own
        cluster, place = np.divmod(np.arange(k * width), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(place), pa.array(np.repeat(counts, width)), pa.array([str(x) for x in totals.ravel()])],
            ["cluster", "place", "n", "total"],
        )

    parts = kept.select("v").mapInArrow(sums, "cluster long, place long, n long, total string")
    whole = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in whole.where("n > 0").collect():  # a row for each component of a centroid
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) for every vector."""
    test = Tournament(centroids)

    def assign(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1))
            number = np.concatenate([test.nearest(vectors[at : at + PART]) for at in range(0, len(vectors), PART)] or [np.zeros(0, np.int64)])
            far = test.distances(vectors, number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return kept.select("id", "v").mapInArrow(assign, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """A row per kept vector: its id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated rows count
    as often as they occur and give a row each; rows without an id take part as well. ``distance`` is squared,
    ``cluster_inertia`` its sum over the cluster and ``inertia`` that over all; both raise an error beyond 64 bits.
    ``centroid_sha256`` belongs to the components of the final centroid as decimal numbers, comma-joined. Other
    columns aren't read; without a kept vector there are no rows.
    """
    own = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    kept = staged(own.where(usable(F.col("v"), dimensions)).select("id", quantized(F.col("v"), scale).alias("v")), "vectors")
    centroids = starts(kept, clusters, seed)
    if not len(centroids):
        centroids, rounds = np.zeros((1, dimensions), np.int64), 0
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    out = staged(assigned(kept, centroids), "assigned")
    discard(kept)
    whole = F.col("distance").cast("decimal(38,0)")
    sums = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(whole).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    if max(sums.values(), default=0) >= 1 << 63 or sum(sums.values()) >= 1 << 63:
        raise OverflowError("the inertia doesn't fit 64 bits")
    # A row for each cluster, so it may be broadcast.
    told = pd.DataFrame({"cluster": range(len(names)), "cluster_inertia": [sums.get(i, 0) for i in range(len(names))], "inertia": sum(sums.values()), "centroid_sha256": names})
    table = out.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = out.join(F.broadcast(table), "cluster")
    return joined.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
