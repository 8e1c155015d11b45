"""Bit-plane clustering, large-item packing and pair-bound search against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import bit_planes, large_item_packing, pair_bounds


# -- clustering ------------------------------------------------------------

def plain_clusters(rows, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for i, own in members.items():
            centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return Counter(found), centroids


def vectors(seed, n, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, spread) for _ in range(64)]) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, [0.5] * 63), (n + 3, [0.5] * 65), (n + 4, [None] + [0.5] * 63),
            (n + 5, [float("nan")] * 64), (n + 6, [float("inf")] + [0.1] * 63), (None, [0.25] * 64), (3, rows[4][1]), (3, rows[4][1])]


@pytest.mark.parametrize("seed,n,clusters,spread", [(1, 90, 7, 1.0), (2, 60, 40, 40.0), (3, 4, 40, 1.0)])
def test_clusters(spark, seed, n, clusters, spread):
    rows = vectors(seed, max(n, 5), spread)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(1) for c in ("id", "cluster", "planes", "order", "whole")}).repartition(3)
    members, centroids = bit_planes.cluster(frame, clusters=clusters)
    want, points = plain_clusters(rows, clusters, 5)
    got = [tuple(r) for r in members.collect()]
    assert Counter(got) == want
    summary = {r.cluster: r for r in centroids.collect()}
    assert [summary[i].centroid for i in range(len(points))] == points
    for i, r in summary.items():
        own = [d for _, c, d in got if c == i]
        assert (r.n, r.cluster_inertia, r.inertia) == (len(own), sum(own), sum(d for *_, d in got))


def test_clusters_with_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    members, _ = bit_planes.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), clusters=30)
    assert len({r.cluster for r in members.collect()}) == 2
    assert Counter(tuple(r) for r in members.collect()) == plain_clusters(rows, 30, 5)[0]


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert [t.count() for t in bit_planes.cluster(empty)] == [0, 0]
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        bit_planes.cluster(huge)


@pytest.mark.parametrize("low,high", [(0, 0), (-1, 0), (0, 1), (-128, 127), (-(1 << 27), (1 << 27) - 1)])
def test_planes_give_exact_products(low, high):
    r = np.random.default_rng(1)
    a, b = (r.integers(low, high, (n, 64), endpoint=True) for n in (9, 5))
    width = bit_planes.width_of(low, high)
    left, right = bit_planes.to_planes(a, width), bit_planes.to_planes(b, width)
    assert (bit_planes.products(left, right) == a @ b.T).all()
    assert (bit_planes.squares(left) == (a * a).sum(axis=1)).all()


# -- packing ---------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return open(large_item_packing.VOCABULARY, encoding="utf-8").read()


AWKWARD = [
    None, "", " \n\t ", "One two  three", "x" * 9000, "naïve café ́a ΑΣ Σ ﬁ İstanbul", "it's we'll 12 345 :-) <|endoftext|>b",
    "a b c\u0085d\x1ce \x0bf", "漢字 かな 🙂🙂 ‍", "Tail ", "same same same", "﻿mark",
]


def test_words_encode_like_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocabulary)
    encoder = large_item_packing.Encoder(vocabulary, 0)
    for texts in (AWKWARD, AWKWARD[::-1], [None], []):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        encoder.clear()


@pytest.mark.parametrize("seed", range(6))
def test_parts_of_words_encode_like_whole_texts(vocabulary, seed):
    from tokenizers import Tokenizer

    whole, r = Tokenizer.from_str(vocabulary), random.Random(seed)
    letters = ["a", "J", "S", "s", "t", "ll", "ñ", "Ñ", "×", "÷", "1", "9", ",", ".", "'", "—", "…", "-", "|", "<", ">", " ", "\n", "\u00a0", "漢", "İ", "Σ"]
    letters += {0: [], 1: ["\u030c", "\u0301"], 2: ["<|endoftext|>", "<|ENDOFTEXT|>"]}[seed % 3]
    texts = ["".join(r.choices(letters, k=r.randint(0, 25))) for _ in range(1500)]
    ids, bounds = large_item_packing.Encoder(vocabulary, 0).encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids + [0], text


def placed(counts, capacity):
    """Sequences as lists of (offset, length), after checking that every piece is there once."""
    plan = large_item_packing.Plan(counts, capacity)
    sequences, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, per, offset in plan.runs:
        for i in range(n):
            sequences[sequence + i // per].append((offset + i % per * length, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(sequences) == list(range(plan.sequences))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def plain_best_fit(counts, capacity):
    """Sequences of best fit, one piece at a time, after pairing large pieces the same way."""
    large = sorted((n for n, c in counts.items() if 3 * n > capacity for _ in range(c)), reverse=True)
    rooms = []
    while large:
        room = capacity - large.pop(0)
        partner = next((i for i, n in enumerate(large) if n <= room), None)
        rooms.append(room - (large.pop(partner) if partner is not None else 0))
    for n in sorted((n for n, c in counts.items() if 3 * n <= capacity for _ in range(c)), reverse=True):
        fit = min(((x, i) for i, x in enumerate(rooms) if x >= n), default=(None, None))[1]
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[fit] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 100])
    counts = {n: r.randint(1, 30) for n in r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 12)))}
    assert len(placed(counts, capacity)) == plain_best_fit(counts, capacity)
    assert placed({}, 10) == {}


@pytest.mark.parametrize("seed", range(20))
def test_large_pieces_need_the_fewest_sequences(seed):
    r = random.Random(seed)
    pieces = [r.randint(11, 30) for _ in range(8)]

    def most_pairs(own):
        if len(own) < 2:
            return 0
        rest = own[1:]
        return max([most_pairs(rest)] + [1 + most_pairs(rest[:i] + rest[i + 1:]) for i, x in enumerate(rest) if own[0] + x <= 30])

    assert len(placed(Counter(pieces), 30)) == 8 - most_pairs(pieces)


def test_sequences(spark, vocabulary):
    from tokenizers import Tokenizer

    whole, r = Tokenizer.from_str(vocabulary), random.Random(1)
    rows = [*enumerate(AWKWARD)] + [(100 + i, " ".join(r.choices(["a", "stone", "Qxv", "9"], k=r.randint(0, 90)))) for i in range(300)]
    rows += [(None, "no id"), (None, None), (7, "other text"), (7, "other text")] + [(900, "hot one")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("piece", "length", "ids", "sequence_id", "offset", "start")}).repartition(5)
    got = large_item_packing.pack(docs, capacity=64).collect()
    pieces = Counter()
    for doc, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        pieces.update((doc, i, 64 * i, tuple(ids[64 * i:64 * i + 64])) for i in range(-(-len(ids) // 64)))
    assert Counter((x.doc_id, x.piece, x.start, tuple(np.frombuffer(bytes(x.ids), "<u4").tolist())) for x in got) == pieces
    sequences = defaultdict(list)
    for x in got:
        assert x.length == len(x.ids) // 4
        sequences[x.sequence_id].append((x.offset, x.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    assert len(sequences) <= 1.02 * sum(x.length for x in got) / 64 + 1


def test_sequences_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert large_item_packing.pack(empty).collect() == []


# -- ranked search ---------------------------------------------------------

def plain_ranks(docs, queries, k):
    lower = {i: i + 32 for i in range(65, 91)}
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall((t or "").translate(lower))
    own = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in queries:
        if i is not None and (asked.get(i) is None or (t or "").encode() > asked[i].encode()):
            asked[i] = t if t is not None else asked.get(i)
    out = []
    for i, text in asked.items():
        terms = [t for t in split(text) if df[t]]
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for doc, c in own:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // total if total else 75
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms)
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(i, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcÉß漢9") for _ in range(r.randint(1, 4))) for _ in range(60)]
    pick = lambda k: r.choice([" ", "-", "\n", "_"]).join(words[min(int(r.expovariate(0.08)), 59)] for _ in range(k))
    docs = [(i, pick(r.randint(0, 40))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, " ".join(words * 200)), (None, words[3]), (None, words[3])]
    docs += [(n + 4 + i, docs[1][1]) for i in range(30)] + [(2, words[5].upper())]
    queries = [(i, pick(r.randint(1, 30))) for i in range(15)]
    return docs, queries + [(50, None), (51, ""), (52, "unknownword"), (None, words[0]), (53, words[0]), (53, words[1]), (54, " ".join(words * 3))]


@pytest.mark.parametrize("seed,k,slice_bytes,query_bytes", [(1, 20, 1 << 20, 1 << 20), (2, 3, 300, 200), (3, 1, 100, 1 << 20)])
def test_ranked_search(spark, seed, k, slice_bytes, query_bytes):
    docs, queries = texts(seed, 120)
    extra = {c: F.lit(1) for c in ("score", "rank", "ids", "terms", "tf")}
    lists = pair_bounds.index(spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra).repartition(3), slice_bytes=slice_bytes)
    got = pair_bounds.search(
        lists, spark.createDataFrame(queries, "item_id long, text string").withColumns(extra), k=k, query_bytes=query_bytes).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == plain_ranks(docs, queries, k)


def test_ranked_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = some.withColumnRenamed("doc_id", "item_id")
    assert pair_bounds.search(pair_bounds.index(empty), asked).collect() == []
    assert pair_bounds.search(pair_bounds.index(some), asked.where("false")).collect() == []
    assert pair_bounds.search(pair_bounds.index(spark.createDataFrame([(1, None)], "doc_id long, text string")), asked).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_pairing_has_the_least_sum(seed):
    r = np.random.default_rng(seed)
    most = r.integers(0, 50, (3, 7))
    joined = np.maximum(np.maximum(most[:, :-1], most[:, 1:]), r.integers(0, 90, (3, 6)))
    joined = np.minimum(joined, most[:, :-1] + most[:, 1:])
    reach, taken = pair_bounds.pairing(most, joined)
    for q in range(3):
        sums = []
        for chosen in itertools.product([False, True], repeat=6):
            if not any(a and b for a, b in zip(chosen, chosen[1:])):
                alone = [not (i < 6 and chosen[i]) and not (i and chosen[i - 1]) for i in range(7)]
                sums.append(int(most[q][alone].sum() + joined[q][list(chosen)].sum()))
                if chosen == tuple(taken[q].tolist()):
                    assert sums[-1] == reach[q]
        assert reach[q] == min(sums) and not (taken[q][:-1] & taken[q][1:]).any()


def test_pair_bounds_skip_what_single_maxima_cannot():
    """Two terms that never meet: the sum of maxima reaches the floor, the pair's bound does not."""
    most, joined = np.array([[10, 9]]), np.array([[10]])
    reach, taken = pair_bounds.pairing(most, joined)
    assert reach.tolist() == [10] and taken.tolist() == [[True]] and most.sum() == 19
