"""Lloyd's centroids in whole numbers, on distinct vectors with their multiplicities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, small, stage

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: Stands before an id in the hash that orders the starting vectors.
SEED = 3
#: A quantised component is at most this, so that squared distances of 64 components are longs.
LARGEST = 1 << 27
#: A vector that more than this share of all rows have is heavy; there are fewer of them than the share's inverse.
HEAVY_SHARE = 1 / 1024
#: Distinct vectors that a task compares with the centroids at a time.
AT_ONCE = 1024


def quantised(vector: Column, scale: int = SCALE, dimensions: int = DIMENSIONS) -> Column:
    """floor(scale * x) of each component, x in double precision; null for other lengths, nulls and what isn't finite, and where a component is beyond LARGEST."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    return F.when(F.coalesce((F.size(vector) == dimensions) & fits, F.lit(False)), F.transform(vector, lambda x: whole(x).cast("int")))


def key_of(vector: Column) -> Column:
    """128 bits that stand for a quantised vector."""
    return F.unhex(F.md5(F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and the squared distance, in whole numbers."""
    cluster, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for a in range(0, len(vectors), AT_ONCE):
        apart = vectors[a : a + AT_ONCE, None, :] - centroids[None, :, :]
        squared = np.einsum("nkd,nkd->nk", apart, apart)
        cluster[a : a + AT_ONCE] = squared.argmin(axis=1)
        distance[a : a + AT_ONCE] = squared.min(axis=1)
    return cluster, distance


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, at, weight, total: of each cluster and component the weighted sum, and the cluster's rows. Each task adds up its own vectors, so that a few rows a task are shuffled."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(k, object), np.zeros((k, width), object)
        for batch in batches:
            vectors, weights = _rows(batch.column(0), width), batch.column(1).to_numpy()
            # what a long can't hold is added up in whole numbers of any size
            if float(weights.sum()) * LARGEST >= 2**62:
                weights = weights.astype(object)
            cluster, _ = nearest(vectors, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                weight[c] += int(weights[own].sum())
                total[c] += (vectors[own] * weights[own][:, None]).sum(axis=0).astype(object)
        filled = [c for c in range(k) if weight[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c in filled for _ in range(width)], pa.int32()),
                pa.array([at for _ in filled for at in range(width)], pa.int32()),
                pa.array([weight[c] for c in filled for _ in range(width)], pa.int64()),
                pa.array([Decimal(int(x)) for c in filled for x in total[c]], pa.decimal128(38)),
            ],
            ["cluster", "at", "weight", "total"],
        )

    out = points.select("vector", "weight").mapInArrow(run, "cluster int, at int, weight bigint, total decimal(38,0)")
    return out.groupBy("cluster", "at").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, weight, cluster, distance of distinct vectors (key, weight, vector)."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_rows(batch.column(2), width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "weight", "cluster", "distance"])

    return points.select("key", "weight", "vector").mapInArrow(run, "key binary, weight bigint, cluster int, distance bigint")


def moved(centroids: np.ndarray, found: list[Row]) -> np.ndarray:
    """Each non-empty centroid becomes the floor of its vectors' mean, component by component."""
    out = centroids.copy()
    for row in found:
        out[row.cluster, row.at] = int(row.total) // row.weight
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _long(value: int) -> Column:
    """A long, or null for what is beyond one."""
    return F.lit(value if value < 2**63 else None).cast("long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """The id, and cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256.

    Rows are quantised and grouped: what Lloyd's rounds read is a staged table of distinct vectors with multiplicities, and
    what a round brings to the driver is k times the components. A round that moves nothing is the last one that counts. The
    assignments go back to the rows by the vector's key: those of heavy vectors, a bounded number, are sent to every task, so
    that no task gets all rows of one vector; the others meet by a shuffle, which moves ids and keys only.

    Start: the k rows with the least SHA-256 of "seed:id" (ties by the vector; rows without an id last, and they have a
    cluster like any others). With fewer rows there are fewer centroids. Rows that `quantised` finds no vector for take no
    part. Repeated rows count as often as they are there; an empty table gives none; a sum beyond a long is null."""
    width = dimensions
    rows = df.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale, dimensions).alias("vector")).where("vector is not null").withColumn("key", key_of(F.col("vector")))
    points = stage(rows.groupBy("key", "vector").agg(F.count("*").alias("weight")), "points")
    first = rows.select("vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("order")).orderBy(F.col("order").asc_nulls_last(), "vector").limit(k)
    centroids = np.array([row.vector for row in first.collect()], np.int64).reshape(-1, width)
    for _ in range(rounds if len(centroids) else 0):
        then = moved(centroids, sums(points, centroids).collect())
        if (then == centroids).all():
            break
        centroids = then
    placed = stage(assign(points, centroids), "placed")
    discard(points)
    by = {row.cluster: row for row in placed.groupBy("cluster").agg(F.sum("weight").alias("rows"), F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("inertia")).collect()}
    heavy_from = int(sum(row.rows for row in by.values()) * HEAVY_SHARE)
    found = placed.select("key", "cluster", "distance")
    heavy, light = found.where(placed["weight"] > heavy_from), found.where(placed["weight"] <= heavy_from)
    mine = rows.select("id", "key")
    out = mine.join(F.broadcast(heavy), "key").unionByName(mine.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(small(light), "key"))
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    inertia = [int(by[c].inertia) if c in by else 0 for c in range(max(len(centroids), 1))]
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance",
        of([_long(x) for x in inertia]).alias("cluster_inertia"), _long(sum(inertia)).alias("inertia"), of([F.lit(digest(c)) for c in centroids] or [F.lit("")]).alias("centroid_sha256"),
    )
