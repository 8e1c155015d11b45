"""Exact top-k search by inner product with multi-resolution segment statistics.

Queries and rows are dealt into a grid of blocks; each cell sees one block of
each.  In a cell every vector has means and deviations of its segments, coarse
to fine.  With segment lengths n, means m and deviations s, the distance of q
and x is at least sum n * ((m_q - m_x)**2 + (s_q - s_x)**2), and as
|q|**2 = sum n * (m_q**2 + s_q**2), the inner product is at most
sum n * (m_q * m_x + s_q * s_x).  Rows whose bound is below the k-th best exact
score found so far are dropped, level by level; exact integer scores of the
survivors decide.  A cell returns at most k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm.packed import one_array

LEVELS = (1, 4, 16)
QUERY_BLOCK = 2048
ROW_BLOCK = 16384


def segment_features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, times the root of their lengths."""
    edge = np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int)
    n = np.diff(edge)
    mean = np.add.reduceat(rows, edge[:-1], axis=1) / n
    spread = np.add.reduceat(rows * rows, edge[:-1], axis=1) / n - mean * mean
    return np.hstack([mean, np.sqrt(np.maximum(spread, 0))]) * np.sqrt(np.tile(n, 2))


def exact(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi), np.int64)
    for a in range(0, len(qi), 1 << 16):
        b = slice(a, a + (1 << 16))
        out[b] = np.einsum("ij,ij->i", queries[qi[b]], rows[xi[b]])
    return out


def best(query_ids, queries, ids, rows, k, levels=LEVELS):
    """(query number, row number, score) of the k highest scores per query; ties to smaller ids."""
    found = []
    floats = rows.astype(np.float64)
    sides = [(segment_features(queries.astype(np.float64), s), segment_features(floats, s)) for s in levels]
    for a in range(0, len(queries), 128):
        own = slice(a, a + 128)
        part = queries[own]
        open_ = query_ids[own, None] != ids[None, :]
        floor = np.full(len(part), -np.inf)
        for of_queries, of_rows in sides:
            bound = of_queries[own] @ of_rows.T
            bound += 1e-9 * np.abs(bound) + 1e-3
            bound[~open_] = -np.inf
            near = min(k, len(rows))
            seed = np.argpartition(bound, -near, axis=1)[:, -near:]
            qi = np.repeat(np.arange(len(part)), near)
            score = np.where(open_[qi, seed.ravel()], exact(part, rows, qi, seed.ravel()), -np.inf)
            if near == k:
                floor = np.maximum(floor, score.reshape(len(part), near).min(axis=1))
            open_ &= bound >= floor[:, None]
        qi, xi = np.nonzero(open_)
        score = exact(part, rows, qi, xi)
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = rank < k
        found.append((qi[keep] + a, xi[keep], score[keep]))
    return [np.concatenate(x) for x in zip(*found)]


def vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and the matrix of floor(256 * x)."""
    lists = one_array(column)
    size = np.diff(np.asarray(lists.offsets))
    flat = np.floor(256.0 * np.asarray(lists.flatten()).astype(np.float64)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = at, flat[start[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.int64)
    return out


def search(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows, all if fewer.

    The score is the integer inner product of floor(256 * x); it must fit a long.
    Ties go to the smaller id.  Rows without id, and vectors that are null, empty
    or hold null or non-finite components, take no part; vectors of another
    length than the query's are not its candidates.  Rows that repeat an id are
    separate candidates; if a query's id repeats, its greatest vector (compared
    item by item) is asked.  Other columns are ignored; no queries, no rows.
    """
    vector = F.col(vector_col)
    valid = rows.where(
        F.col(id_col).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asked"))
    count = valid.agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).first()
    across, down = (max(1, -(-(n or 0) // size)) for n, size in ((count.q, query_block), (count.n, row_block)))
    asked = valid.where("asked").groupBy("id").agg(F.max("vector").alias("vector"))

    def dealt(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return side.select(
            "id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("across", "down")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            query_ids, ids = (one_array(t["id"]).to_numpy() for t in (left, right))
            of_rows = vectors(right["vector"])
            for n, (at, matrix) in vectors(left["vector"]).items():
                if n in of_rows:
                    where, other = of_rows[n]
                    qi, xi, score = best(query_ids[at], matrix, ids[where], other, k)
                    out.append((query_ids[at][qi], ids[where][xi], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = dealt(asked, "across", across, "down", down).cogroup(
        dealt(valid, "down", down, "across", across)
    ).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
