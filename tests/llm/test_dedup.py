"""Substring dedup on words and bytes, and the Jaccard join, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import corpus, in_order, near_groups, without_strings, without_windows

from mailgrain.llm import components, packed, parity_join, suffix_dedup, window_dedup

ODD = [(3, "w1 w2 w3 w4 w5 w6"), (3, "w1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6"), (None, None), (7, "w2 w3 w4 w5 w6 x")]


@pytest.mark.parametrize("rows", [corpus(1), corpus(2, 30, 4, 30), ODD, []], ids=["mixed", "few-words", "odd", "empty"])
def test_windows(table, rows):
    got = window_dedup.remove_repeats(table(rows), length=5, chunk_bytes=2000).collect()
    assert sorted(map(repr, got and [tuple(r) for r in got])) == sorted(map(repr, without_windows(rows, 5)))


@pytest.mark.parametrize("crowd", [4096, 2])
@pytest.mark.parametrize("rows", [corpus(3), corpus(4, 30, 3, 30), ODD, []], ids=["mixed", "few-words", "odd", "empty"])
def test_strings(table, rows, crowd):
    got = suffix_dedup.remove_repeats(table(rows), length=12, chunk_bytes=2000, crowd=crowd).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, without_strings(rows, 12)))


def test_strings_across_segments(table, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    rows = corpus(5)
    got = suffix_dedup.remove_repeats(table(rows), length=12).collect()
    assert sorted(repr((r.doc_id, r.n_removed, bytes(r.kept))) for r in got) == sorted(
        repr((a, c, e)) for a, _, c, _, e in without_strings(rows, 12))


def test_whole_characters_and_kept_columns(table):
    rows = [(1, "é" * 20), (2, "a" + "é" * 20 + "b")]
    got = suffix_dedup.remove_repeats(table(rows), length=9, whole_characters=True, keep=("score",)).collect()
    assert all(r.score == "x" and bytes(r.kept).decode() is not None for r in got)


def collision(n):
    """Two different words of 2**n bytes that any polynomial modulo 2**64 takes for one, if n is 10 or more."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_made_to_collide(table):
    one, two = collision(11)
    rows = [(1, " ".join([one, *(f"w{i}" for i in range(19))])), (2, " ".join([two, *(f"w{i}" for i in range(19))]))]
    got = window_dedup.remove_repeats(table(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 20, 0), (2, 20, 0)]
    got = parity_join.near_duplicates(table([(1, one), (2, two), (3, two)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 2)]


def test_word_hashes_of_two_seeds_are_independent():
    texts = ["x", "y" * packed.LONG_WORD, "z" * (packed.LONG_WORD + 1), "z" * (packed.LONG_WORD + 1), *collision(11)]
    data, bounds = packed.utf8(pa.array(texts))
    one, two = (packed.word_hashes(data, bounds[:-1], bounds[1:], seed) for seed in (0, 1))
    for h in (one, two):
        assert len(set(h.tolist())) == 5 and h[2] == h[3]
    assert not set(one.tolist()) & set(two.tolist())


def test_suffix_sort_is_a_stable_sort():
    r = random.Random(1)
    data = np.array([r.choice(b"ab") for _ in range(3000)], np.uint8)
    at = np.array(sorted(r.sample(range(2900), 900)))
    group = np.sort(np.array([r.randrange(5) for _ in at]))
    order = suffix_dedup.Suffixes(data, 8).sort(at, group)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(900), key=lambda i: (group[i], raw[at[i]:at[i] + 8], i))


def test_jaccard_groups(table):
    rows = corpus(6, 60)
    long = " ".join(f"w{i}" for i in range(300))
    rows += [(100 + i, long.replace(f" w{7 * i + 3} ", f" e{i} ")) for i in range(12)]
    rows += [(200 + i, f"same few {i % 2}") for i in range(6)]
    got = parity_join.near_duplicates(table([*rows, (None, "A b C"), (100, long)])).collect()
    named = {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert set(near_groups(rows)) <= named | {x for x in near_groups(rows) if x[0] == 100}
    assert len(got) == len(rows) + 2
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]


def test_equal_sets_have_equal_hashes_wherever_they_lie(spark):
    rows = [(i, f"a{i} b c d e f{i % 7} g h") for i in range(500)] + [(1000 + i, "same text of a few more words here") for i in range(500)]
    random.Random(1).shuffle(rows)
    facts = parity_join.describe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keys = {(r.one, r.two) for r in facts if r.doc_id >= 1000}
    assert len(keys) == 1 and len({(r.one, r.two) for r in facts}) == 501


def test_a_family_is_dealt_over_many_tasks(spark):
    rows = spark.createDataFrame([(1, 10, 0, i, i, 40, b"") for i in range(10)],
                                 "piece long, size long, low long, doc_id long, root long, n long, sketch binary")
    plan = parity_join.across(rows, False)._jdf.queryExecution().executedPlan().toString()
    group = plan[plan.index("FlatMapGroupsInArrow"):]
    assert "hashpartitioning(low" in group and "REPARTITION_BY_COL" in group[:group.index("Generate")]


def test_jaccard_of_nothing(table):
    assert parity_join.near_duplicates(table([])).collect() == []


def test_linked_sets_share_a_leading_piece():
    """The pigeonhole argument, on random sets at the edge of the threshold."""
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(1, 400))
        common = int(np.ceil(n * r.uniform(0.6, 1)))
        base = r.integers(0, 2**63, 2 * n + 2, dtype=np.int64).view(np.uint64)
        a, b = np.sort(base[:n]), np.sort(base[n - common:n - common + int(r.integers(common, n + 2))])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        value = np.concatenate([a, b])
        key, doc = parity_join.piece_keys(value, np.array([0, len(a), len(value)]))
        assert set(key[doc == 0]) & set(key[doc == 1])
        x, y = (np.frombuffer(s, np.uint64) for s in parity_join.sketches(value, np.array([0, len(a), len(value)])))
        assert parity_join.hamming(x, y) <= len(a) + len(b) - 2 * both <= parity_join.distance(len(a), len(b))


def test_blocks_of_a_large_piece_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    value = np.sort(np.arange(1, 41, dtype=np.uint64))
    sketch = parity_join.sketches(value, np.array([0, 40]))[0]
    rows = spark.createDataFrame([(p, 10, 0, i, i, 40, sketch) for i in range(10) for p in (1, 2)],
                                 "piece long, size long, low long, doc_id long, root long, n long, sketch binary")
    assert {(r.a, r.b) for r in parity_join.across(rows, False).collect()} == {(i, j) for j in range(10) for i in range(j)}
    assert parity_join.across(rows, True).count() >= 9


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(31)}, 100: 100, 103: 100, 105: 100}


def test_order_of_brute_force():
    assert [r[0] for r in in_order(ODD)] == [3, 3, 7, None, None]
