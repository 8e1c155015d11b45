"""Mixing, packing and search against plain versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import curriculum, length_buckets, ordering, topk_search


def plain_targets(sizes, weights):
    """Water filling by repeated sharing."""
    left, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", "ü", None, "c", "tiny"][:8 - (i > 3)]), r.choice([None, 0, 5, 9, 40, 300])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns(
        {"target": F.lit("old"), "weight": F.lit(1), "turn": F.lit(2)})
    got = curriculum.mix(docs, rows_per_range=20).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = defaultdict(int)
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source])
        assert 0 <= x.copies <= 3 and x.taken == x.copies * (x.size or 0) and len(x.positions) == x.copies
        assert all(0 <= p <= 1 for p in x.positions) and x.weight == 1
    for s in names:
        assert abs(taken[s] - target[s]) <= 300
    again = curriculum.mix(docs.repartition(7), rows_per_range=20).collect()
    assert sorted((x.doc_id, x.copies) for x in again) == sorted((x.doc_id, x.copies) for x in got)


def test_mixing_order(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 10) for i in range(300)], "doc_id long, source string, size long")
    order = curriculum.training_order(curriculum.mix(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early = [r.source for r in order[: len(order) // 3]]
    late = [r.source for r in order[-len(order) // 3:]]
    assert early.count("a") > late.count("a") and early.count("c") < late.count("c")


def test_due_inverts_the_integral(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))
    total = curriculum.area(knots)

    def integral(t):
        out = 0.0
        for (a, w), (b, v) in zip(knots, knots[1:]):
            if t > a:
                e = min(t, b)
                out += (e - a) * (w + w + (v - w) * (e - a) / (b - a)) / 2
        return out / total

    rows = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", curriculum.due(F.col("u"), curriculum.pieces(knots)))
    assert all(integral(r.t) == pytest.approx(r.u, abs=1e-9) for r in rows.collect())


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert curriculum.mix(empty).collect() == []
    alone = spark.createDataFrame([(1, None, None), (None, None, 0)], "doc_id long, source string, size long")
    assert {(r.copies, r.taken) for r in curriculum.mix(alone).collect()} == {(1, 0)}


def test_best_bounds():
    r = random.Random(1)
    for _ in range(200):
        n, most = r.randint(1, 9), r.randint(1, 4)
        length, count = sorted(r.sample(range(1, 60), n)), [r.randint(1, 20) for _ in range(n)]

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(length, count))

        got = length_buckets.best_bounds(np.array(length), np.array(count), most)
        assert len(got) <= most and padding(got) == min(
            padding([*s, length[-1]]) for k in range(min(most, n)) for s in itertools.combinations(length[:-1], k))


def least_padding(lengths, most):
    """The least padding in at most so many buckets, by trying every last bucket of every prefix."""
    own, cost = sorted(lengths), {0: 0}
    for _ in range(most):
        cost = {j: min((cost[i] + sum(own[j - 1] - v for v in own[i:j]) for i in range(j) if i in cost), default=0) if j else 0
                for j in range(len(own) + 1)}
    return cost[len(own)]


def test_long_documents_have_least_padding(spark):
    """Bounds are lengths of documents also from 64 words up, and padding is the exact optimum."""
    def packed(lengths, buckets):
        docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
        return length_buckets.pack(docs, buckets=buckets).collect()

    assert {(x.bound, x.padding) for x in packed([1000] * 30, 16)} == {(1000, 0)}
    r = random.Random(4)
    for low, high, buckets in ((65, 200, 3), (1000, 1100, 4), (65, 20_000, 5)):
        lengths = [r.randint(low, high) for _ in range(60)]
        got = packed(lengths, buckets)
        assert sum(x.padding for x in got) == least_padding(lengths, buckets)
        assert {x.bound for x in got} <= set(lengths) and len({x.bound for x in got}) <= buckets


def test_packing(spark):
    r = random.Random(2)
    rows = [(i % 290, r.choice([1, 3, 7, 64, 65, 100, 1000])) for i in range(300)] + [(None, 5), (400, None), (401, 0), (402, 10**6)]
    docs = spark.createDataFrame(rows, "doc_id long, length long").withColumns({"batch": F.lit("old"), "n": F.lit(1)})
    got = length_buckets.pack(docs, buckets=4, budget=2000, rows_per_range=40).collect()
    assert len(got) == len(rows) and all(x.n == 1 for x in got)
    batches = defaultdict(list)
    for x in got:
        if not x.length:
            assert (x.bucket, x.bound, x.batch, x.padding) == (None, None, None, 0)
            continue
        assert x.length <= x.bound and x.padding == x.bound - x.length
        batches[x.bucket, x.batch].append(x)
    for (bucket, batch), own in batches.items():
        room = max(2000 // own[0].bound, 1)
        assert len({x.bound for x in own}) == 1 and len(own) <= room
        assert len(own) == room or batch == max(b for k, b in batches if k == bucket)
    assert len({k for k, _ in batches}) <= 4
    bounds = {x.bucket: x.bound for x in got if x.length}
    assert [bounds[k] for k in sorted(bounds)] == sorted(bounds.values())
    assert length_buckets.pack(docs.limit(0)).collect() == []


def test_rows_without_id_are_dealt_apart(spark):
    """A third of all rows without id, of one size and source: no range holds many of them, and reruns agree."""
    n = F.col("id")
    docs = spark.range(6000).select(
        F.when(n % 3 != 0, n).alias("doc_id"), F.lit("a").alias("source"), F.lit(7).alias("size"), F.lit(7).alias("length"),
        F.xxhash64(n).alias("text_hash"), F.create_map(F.lit("k"), n).alias("a map"), n.alias("x.y"))
    ranges = docs.select(F.substring(ordering.spread_order(docs, "doc_id"), 1, 1).alias("r"), F.col("doc_id").isNull().alias("none"))
    assert ranges.where("none").groupBy("r").count().agg(F.max("count")).first()[0] < 250
    for act, told in ((curriculum.mix, "positions"), (length_buckets.pack, "batch")):
        one, two = (act(d, rows_per_range=100).select("doc_id", "text_hash", told).collect() for d in (docs, docs.repartition(5)))
        assert len(one) == 6000 and sorted(map(str, one)) == sorted(map(str, two))
    assert sum(len(r.positions) for r in curriculum.mix(docs, rows_per_range=100).collect()) == 6000


def plain_top(rows, k=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % 5 == 0}):
        vector = max(v for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q and len(v) == len(vector))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_search(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.3, 1.0, r.gauss(0, 1)]) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, None), (301, []), (302, [None] * 20), (305, [float("nan")] * 20),
             (310, [float("inf")] * 20), (None, rows[3][1]), (315, [1.0, 2.0]), (316, [2.0, 1.0]), (320, [1.0] * 3), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"id": F.lit("x"), "rank": F.lit(0), "vector": F.lit(1)})
    want = plain_top([(i, v) for i, v in rows])
    for query_block, row_block in ((2048, 16384), (7, 30)):
        got = topk_search.search(table, F.col("vec_id") % 5 == 0, query_block=query_block, row_block=row_block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.search(table.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold():
    r = np.random.default_rng(1)
    q, x = (r.normal(0, 100, (30, 33)) for _ in range(2))
    for s in topk_search.LEVELS:
        assert (topk_search.segment_features(q, s) @ topk_search.segment_features(x, s).T >= q @ x.T - 1e-6).all()


def test_hash_order_is_md5():
    assert hashlib.md5(b"12").hexdigest()[:4] == "c20a"
