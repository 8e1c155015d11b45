"""Packing into optimal length buckets.

The histogram of document lengths over the whole corpus is cut into buckets by
dynamic programming, so that padding every document to the longest of its bucket
wastes least.  Inside a bucket, batches hold as many documents as a token budget
allows.

Documents of a bucket are numbered by length, then hash, by adding sums over
(bucket, range of the hash) to numbers within one range; no bucket goes through one task.
"""

from __future__ import annotations

import itertools
from array import array
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm.ordering import spread_order

BUCKETS = 16
BUDGET = 65_536
ROWS_PER_RANGE = 2048


def best_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets with the least sum of count * (bound - length).

    ``length`` ascends.  The padding without the constant sum of lengths is the
    sum over buckets of its count times its bound, so cost[j] = min over i of
    cost[i] + (rows[j] - rows[i]) * length[j].  For one more bucket that is the
    lowest at length[j] of lines with slope -rows[i], whose order of slopes and of
    questions makes one pass enough: O(buckets * n) time and memory, in whole numbers.
    """
    length, n = [int(v) for v in length], len(length)
    rows = [0, *itertools.accumulate(int(v) for v in count)]
    cost = [r * v for r, v in zip(rows[1:], length)]
    choice = [array("q", bytes(8 * n))]
    for _ in range(min(buckets, n) - 1):
        back, new = array("q", bytes(8 * n)), cost[:]
        # Lines (slope, height, i) that are lowest somewhere ahead.
        lines: deque = deque()
        for j in range(1, n):
            slope, height = -rows[j], cost[j - 1]
            while len(lines) > 1:
                (a, p, _), (b, q, _) = lines[-2], lines[-1]
                if (height - p) * (a - b) > (q - p) * (a - slope):
                    break
                lines.pop()
            lines.append((slope, height, j))
            while len(lines) > 1 and lines[0][0] * length[j] + lines[0][1] >= lines[1][0] * length[j] + lines[1][1]:
                lines.popleft()
            low = lines[0][0] * length[j] + lines[0][1] + rows[j + 1] * length[j]
            # Zero means that fewer buckets do as well.
            if low < new[j]:
                new[j], back[j] = low, lines[0][2]
        choice.append(back)
        cost = new
    bounds, j = [], n
    for back in reversed(choice):
        if back[j - 1] or back is choice[0]:
            bounds.append(length[j - 1])
            j = back[j - 1]
    return bounds[::-1]


def histogram_bounds(docs: DataFrame, length: Column, buckets: int) -> list[int]:
    """Bucket bounds from the exact histogram of all lengths, so every bound is a document's length.

    n different lengths need n * n / 2 words at least: the histogram that is
    collected grows with the root of the corpus, not with it.
    """
    rows = docs.where(length > 0).groupBy(length.alias("length")).count().collect()
    rows = sorted((r["length"], r["count"]) for r in rows)
    return best_bounds(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), buckets) if rows else []


def pack(
    docs: DataFrame, length_col: str = "length", id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """All rows and columns plus bucket, bound, batch and padding.

    ``bucket`` counts from 0 by length, ``bound`` is the padded length, ``batch``
    numbers the batches of a bucket.  A batch holds floor(budget / bound)
    documents, one at least, so only a document longer than the budget exceeds it,
    alone.  ``padding`` is bound - length.

    Rows of null, zero or negative length are empty: bucket, bound and batch are
    null, padding is 0.  Rows that repeat an id are packed like any other; rows
    without id are dealt by a hash of their other columns.  A column of docs that
    has the name of an added one is replaced.  An empty table gives no rows.
    """
    own = docs.drop("bucket", "bound", "batch", "padding")
    length = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    bounds = histogram_bounds(own, length, buckets)
    bucket = bound = F.lit(None)
    for i, top in reversed(list(enumerate(bounds))):
        bucket, bound = F.when(length <= top, i).otherwise(bucket), F.when(length <= top, F.lit(top)).otherwise(bound)
    ranges = max(1, -(-own.count() // rows_per_range))
    rows = own.withColumns({
        "bucket": F.when(length > 0, bucket).cast("int"), "bound": F.when(length > 0, bound).cast("long"),
        "_pack_order": spread_order(own, id_col),
    }).withColumn("_pack_range", F.floor(
        F.conv(F.substring("_pack_order", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")
    ).withColumn("_pack_key", F.coalesce("bucket", F.lit(-1)))
    keys = ["_pack_key", "_pack_range"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_pack_key").orderBy("_pack_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_pack_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_pack_order", length)) - 1
    return (
        rows.withColumn("_pack_number", number).join(sums, keys)
        .withColumn("batch", F.when(F.col("bound").isNotNull(), F.floor(
            (F.col("_pack_before") + F.col("_pack_number")) / F.greatest(F.floor(F.lit(budget) / F.col("bound")), F.lit(1)))))
        .withColumn("padding", F.coalesce(F.col("bound") - length, F.lit(0)))
        .drop("_pack_order", "_pack_range", "_pack_key", "_pack_before", "_pack_number"))
