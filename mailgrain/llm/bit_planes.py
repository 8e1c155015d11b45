"""Centroid clustering on bit planes.

A vector of 64 integers in two's complement is kept as one 64-bit word per bit:
bit i of word b is bit b of component i.  As a component is the sum of its bits
times 2**b, the highest one negative, the inner product of two vectors is the
sum over pairs of planes of both weights times the number of ones in the AND of
the two words.  So all products and distances come from AND and popcount, and
are exact.

The vectors are packed once and stored.  A round is one pass over that table:
every task assigns its vectors and adds up, for each cluster, how often each bit
is set, which is all that crosses the network.  The driver holds the centroids
only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm.packed import one_array
from mailgrain.sources.workspace import stored

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
#: Components below this size have squared distances that fit a long.
LARGEST = 1 << 27
BLOCK = 1024


def width_of(low: int, high: int) -> int:
    """Planes that hold all integers from low to high, sign included."""
    return max(int(high).bit_length(), (-int(low) - 1).bit_length() if low < 0 else 0) + 1


def weights(width: int) -> list[int]:
    return [1 << b for b in range(width - 1)] + [-(1 << (width - 1))]


def to_planes(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) words from (rows, 64) integers."""
    out = np.empty((len(values), width), np.uint64)
    for b in range(width):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def bits_of(words: np.ndarray) -> np.ndarray:
    """The (rows, 64) bits of one plane."""
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both sides by weighted AND-popcounts."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, v in enumerate(weights(left.shape[1])):
        for j, w in enumerate(weights(right.shape[1])):
            if right[:, j].any():
                out += np.bitwise_count(left[:, i, None] & right[None, :, j]).astype(np.int64) * (v * w)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared lengths of all rows."""
    own, weight = np.zeros(len(planes), np.int64), weights(planes.shape[1])
    for i, v in enumerate(weight):
        for j in range(i + 1):
            own += np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64) * (v * weight[j] * (1 if i == j else 2))
    return own


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; the smaller number on ties."""
    cluster, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    of_centroids = squares(centroids)
    for a in range(0, len(planes), BLOCK):
        part = planes[a:a + BLOCK]
        far = squares(part)[:, None] - 2 * products(part, centroids) + of_centroids
        best = far.argmin(axis=1)
        cluster[a:a + BLOCK], distance[a:a + BLOCK] = best, far[np.arange(len(part)), best]
    return cluster, distance


def matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = one_array(column)
    return np.asarray(lists.flatten()).reshape(len(lists), width)


def packed_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The stored planes of all valid vectors, the valid rows themselves, and the number of planes (0: no vector)."""
    vector = F.col(vector_col)
    whole = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    valid = rows.where(
        (F.size(vector) == DIMS)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), whole.alias("whole"))
    ends = valid.agg(F.min(F.array_min("whole")).alias("low"), F.max(F.array_max("whole")).alias("high")).first()
    if ends.low is None:
        return valid, valid, 0
    if max(-ends.low, ends.high + 1) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling, so distances need not fit a long")
    width = width_of(ends.low, ends.high)

    def run(batches):
        for batch in batches:
            planes = to_planes(matrix(batch.column("whole"), DIMS), width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, planes.size + 1, width, np.int32)), pa.array(planes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "planes"])

    planes = valid.select("id", "whole").mapInArrow(run, "id long, planes array<long>")
    return stored(planes, "planes"), valid, width


def assigned(planes: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """id, cluster, distance of every vector."""
    points = to_planes(np.array(centroids, np.int64), width)

    def run(batches):
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column("planes"), width).view(np.uint64), points)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return planes.mapInArrow(run, "id long, cluster int, distance long")


def sums(planes: DataFrame, centroids: list[list[int]], width: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each cluster that has vectors; one row a task and cluster is shuffled."""
    points, weight = to_planes(np.array(centroids, np.int64), width), weights(width)

    def run(batches):
        count, total = np.zeros(len(points), np.int64), np.zeros((len(points), DIMS), np.int64)
        for batch in batches:
            own = matrix(batch.column("planes"), width).view(np.uint64)
            cluster, _ = nearest(own, points)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            count += np.bincount(cluster, minlength=len(points))
            for b in range(width if len(own) else 0):
                total[found] += weight[b] * np.add.reduceat(bits_of(own[order, b]), first, axis=0, dtype=np.int64)
        some = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, DIMS * len(some) + 1, DIMS, np.int32)), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], names=["cluster", "n", "total"])

    parts = planes.select("planes").mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"c{i}") for i in range(DIMS))).collect()
    return {r["cluster"]: (r["n"], [int(r[f"c{i}"]) for i in range(DIMS)]) for r in rows}


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    seed: str = "2:",
) -> tuple[DataFrame, DataFrame]:
    """Lloyd's algorithm in integers: (members, centroids).

    Members are id, cluster, distance (squared) of every vector of exactly 64
    components, none null or non-finite; a component x counts as floor(256 * x).
    Centroids are cluster, n, cluster_inertia, inertia, centroid, one row for each
    centroid.  They start as the vectors with the smallest SHA-256 of the seed and
    the id; rounds assign every vector to its nearest centroid (the smaller number
    on ties) and replace every non-empty one by the floor of its members' mean.
    The last assignment is to the final centroids.

    Null vectors and those of another length, or with null or non-finite
    components, take no part.  Rows without id take part and are the last to start
    a centroid; rows that repeat an id are vectors of their own, the smaller
    vector first.  With fewer vectors than clusters there are as many centroids
    as vectors, without any both tables are empty.  Components of 2**27 and more
    after scaling raise ValueError.  Other columns are ignored.
    """
    spark = rows.sparkSession
    planes, valid, width = packed_vectors(rows, id_col, vector_col)
    summary = "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>"
    if not width:
        none = spark.createDataFrame([], "id long, cluster int, distance long")
        return none, spark.createDataFrame([], summary)
    start = valid.withColumn("order", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)).orderBy(
        F.asc_nulls_last("order"), "whole").select("whole").limit(clusters)
    centroids = [list(r.whole) for r in start.collect()]
    for _ in range(rounds):
        for number, (n, total) in sums(planes, centroids, width).items():
            centroids[number] = [t // n for t in total]
    members = stored(assigned(planes, centroids, width), "members")
    inertia = {r["cluster"]: (r["n"], int(r["d"])) for r in members.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(d for _, d in inertia.values())
    return members, spark.createDataFrame(
        [(i, *inertia.get(i, (0, 0)), whole, c) for i, c in enumerate(centroids)], summary)
