"""Fingerprints, token counts, quality and page extraction."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import corpus, words
from pyspark.sql import functions as F

from mailgrain.llm import block_labeller, quality_machine, token_trees, weighted_sampling


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_fingerprints(table):
    rows = [(i * 3, t) for i, t in corpus(11, 60)] + [(900, "same text"), (901, "same text")]
    got = sorted(weighted_sampling.fingerprint(table([*rows, (None, "abc def")]), rows_per_run=7).collect(),
                 key=lambda r: (r.doc_id is None, r.doc_id))
    rows = sorted((i, t or "") for i, t in rows)
    errors = []
    for n, (row, (doc, text)) in enumerate(zip(got, rows)):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert (row.doc_id, row.text, row.edited) == (doc, text, edited)
        errors += [row.near_edited - jaccard(text, edited), row.near_next - jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.12
    same = [r.fingerprint for r in got if r.text == "same text"]
    assert len(same) == 2 and same[0] == same[1] and len(same[0]) == 8 * weighted_sampling.SAMPLES
    assert all((r.fingerprint == "") == (not words(r.text)) for r in got)
    assert (got[-1].doc_id, got[-1].edited, got[-1].near_next) == (None, "abc ", None)


def test_fingerprints_of_few(table):
    assert weighted_sampling.fingerprint(table([])).collect() == []
    alone = weighted_sampling.fingerprint(table([(5, "ab cd")])).first()
    assert alone.edited == "ab ab" and alone.near_next == 1.0
    twice = weighted_sampling.fingerprint(table([(5, "ab cd"), (5, "ab cd")])).collect()
    assert [r.near_next for r in twice] == [1.0, 1.0]


def test_fingerprints_shuffle_texts_by_run_only(table):
    rows = weighted_sampling.fingerprint(table(corpus(12, 30)))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert all("hashpartitioning(run" in line for line in plan.split("\n") if "Exchange" in line and "Reused" not in line)
    assert "Python" not in plan


PIECES = ["a", "B", " ", "  ", "\n", "'", "s", "'s", "1", "22", "!", "é", " the", "\t", "%%%", "ll", "　", "日本"]


def random_edits(r, size, n=3):
    return [dict(start=(s := r.randint(0, size + 1)), stop=s + r.randint(0, 4), text="".join(r.choices(PIECES, k=r.randint(0, 3))))
            for _ in range(r.randint(0, n))]


def test_token_trees(spark):
    counter = token_trees.Counter(token_trees.read_ranks(spark, token_trees.VOCABULARY))
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choices(PIECES, k=r.randint(0, 25)))
        edits = random_edits(r, len(text))
        pieces = counter.pattern.findall(text)
        tree = token_trees.Tree(counter.counts(pieces))
        edited, _ = token_trees.apply(counter, text, np.cumsum([len(p) for p in pieces], dtype=np.int64), tree, edits)
        want = text
        for start, stop, new in reversed(token_trees.in_bounds(edits, len(text))):
            want = want[:start] + new + want[stop:]
        assert edited == want and tree.total == len(counter.encoding.encode_ordinary(want))
        for low, high in zip(tree.levels, tree.levels[1:]):
            assert high.tolist() == [sum(low[i:i + 2]) for i in range(0, len(low), 2)]


def test_recount(spark):
    counter = token_trees.Counter(token_trees.read_ranks(spark, token_trees.VOCABULARY))
    r = random.Random(6)
    rows = [(i, t, random_edits(r, len(t or ""))) for i, t in corpus(13, 40)]
    rows += [(None, "abc", None), (500, None, [dict(start=None, stop=None, text="new text")]), (501, "abc", [None]), (501, "abc", [])]
    rows.append((502, "many words here " * 5000, [dict(start=9, stop=12, text="!!")]))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_trees.EDITS}").withColumn("tree", F.lit("x"))
    got = token_trees.recount(docs).collect()
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, count(t or "")) for i, t, _ in rows)
    assert all(r.edited_tokens == count(r.edited) for r in got)
    assert next(r.n_encoded for r in got if r.doc_id == 502) < 10
    trees = spark.createDataFrame([(r.doc_id, bytes(r.tree)) for r in got if r.doc_id not in (None, 501)], "doc_id long, old binary")
    again = token_trees.recount(docs.join(trees, "doc_id"), tree_col="old").collect()
    known = {r.doc_id: r for r in got}
    assert all((r.edited, r.edited_tokens, r.n_tokens) == (known[r.doc_id].edited, known[r.doc_id].edited_tokens, known[r.doc_id].n_tokens)
               for r in again) and len(again) == len(rows) - 3
    assert token_trees.recount(docs.limit(0)).collect() == []


def test_sum_of_squares_identity():
    r = np.random.default_rng(2)
    machine = quality_machine.Machine(0.3, r.normal(size=50).astype(np.float32), r.normal(size=(50, 4)).astype(np.float32))
    index, value = r.permutation(50)[:9], r.normal(size=9).astype(np.float32)
    raw = machine.parts(index, value, np.array([0, 9]))[0][0]
    want = 0.3 + machine.weight[index] @ value + sum(
        machine.factor[index[i]] @ machine.factor[index[j]] * value[i] * value[j] for j in range(9) for i in range(j))
    assert raw == pytest.approx(want, rel=1e-4)


def test_quality(spark):
    r = random.Random(8)
    good = lambda: " ".join(r.choices(["plain", "words", "of", "a", "text", "here"], k=40)) + "."
    bad = lambda: " | ".join(r.choices(["plain", "words", "of", "a", "text", "here"], k=40))
    rows = [(i, good() if i % 3 else bad(), None if i % 7 == 0 else 200, i % 3) for i in range(300)]
    docs = spark.createDataFrame([x[:3] for x in rows] + [(900, None, None), (901, "", -5), (902, "z" * 300_000, 0), (None, good(), 1), (1, good(), 1)],
                                 "doc_id long, text string, n_chars long").withColumns({"label": F.lit("x"), "index": F.lit(1)})
    labels = spark.createDataFrame([(i, int(q > 0)) for i, _, _, q in rows] + [(2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    learned = labels.where(~quality_machine.held_out(F.col("doc_id")))
    machine = quality_machine.train(docs, learned)
    got = quality_machine.score(docs, machine, keep=("doc_id", "label")).collect()
    assert len(got) == len(rows) + 5 and all(0 <= x.score <= 1 and x.label == "x" for x in got)
    score = {x.doc_id: x.score for x in got if x.doc_id not in (None, 1)}
    assert all((score[i] >= 0.7) == (q > 0) for i, _, _, q in rows if i != 1)
    assert quality_machine.score(docs.limit(0), machine).collect() == []
    nothing = quality_machine.train(docs, labels.limit(0))
    assert {x.score for x in quality_machine.score(docs.limit(3), nothing).collect()} != set()


def test_sample_has_one_row_of_each_id(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(quality_machine, "fit", lambda index, value, edge, label, size, updates: got.update(edge=edge, label=label))
    docs = spark.createDataFrame([(1, f"text {i} of one", 9) for i in range(500)] + [(i, "other text", 9) for i in range(2, 9)],
                                 "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    quality_machine.train(docs, labels, sample=2)
    assert got["label"].tolist() == [1, 0] and len(got["edge"]) == 3


def test_quality_query_against_explicit_pairs(spark):
    """Every pair of a text's features multiplied out, held-out rows by the standard library's checksum."""
    import math
    import zlib

    from mailgrain.llm import catalogue

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "n_chars")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect()}
    known = spark.read.parquet(f"{folder}/labels.parquet").collect()
    learned = spark.createDataFrame([(r.doc_id, r.quality) for r in known if not held[r.doc_id]], "doc_id long, quality int")
    machine = quality_machine.train(docs, learned)
    got = {r.doc_id: r for r in catalogue.QUERIES["op4_quality"](spark, folder).collect()}
    assert set(got) == set(held)
    for r in docs.collect():
        meta = np.array([[min(math.log1p(r.n_chars) / 20, 1.0)]])
        index, value, _ = quality_machine.features(pa.array([r.text]), meta)
        x, v = value.astype(float), machine.factor[index].astype(float)
        pairs = np.triu((v @ v.T) * np.outer(x, x), 1).sum()
        score = 1 / (1 + math.exp(-min(max(machine.bias + machine.weight[index].astype(float) @ x + pairs, -30), 30)))
        row = got[r.doc_id]
        assert row.held_out == held[r.doc_id] and abs(row.score - score) < 1e-3
        assert row.predicted == (row.score >= 0.7)


def test_labeller_gradients():
    r = np.random.default_rng(3)
    model = block_labeller.Labeller({n: v.astype(np.float64) for n, v in block_labeller.Labeller.fresh().weights.items()})
    x = r.normal(size=(4, 3, block_labeller.WIDTH))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    label = r.integers(0, 2, (4, 3)).astype(float)

    def loss():
        p = block_labeller.sigmoid(model.forward(x, mask)[0])
        return -(mask * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / mask.sum()

    for name, grad in model.gradients(x, mask, label).items():
        flat, spot = model.weights[name].reshape(-1), int(r.integers(model.weights[name].size))
        flat[spot] += 1e-5
        high = loss()
        flat[spot] -= 2e-5
        low = loss()
        flat[spot] += 1e-5
        assert grad.reshape(-1)[spot] == pytest.approx((high - low) / 2e-5, abs=2e-4), name


PAGE = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Menu</a>
<li><a href=/x>Other</a></ul></nav><!-- ad --><div class="ad">Buy now.</div><article><h1>Fish &amp; chips</h1><p><b>One   long
sentence about food &eacute;.<br><p>Two is <i>more</i>over here.</article><form>Search<input></form><footer>&copy; me</footer>"""


@pytest.fixture(scope="module")
def labeller():
    return block_labeller.train()


def test_page_extraction(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", PAGE), (4, "u", "<div>" * 3000 + "deep" + "<b>" * 3000),
            (5, "u", "<article>" + "<p>A sentence of some words, again.</p>" * 3000 + "</article>"), (6, "u", "&#0; \x00 &bogus; <![CDATA[x]]>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "keep_url": F.lit("y")})
    got = block_labeller.extract(pages, labeller).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == ["Fish & chips One long sentence about food é. Two is moreover here."] * 2
    assert all(r.text == "" for r in got if r.page_id in (2, 3))
    assert next(r.text for r in got if r.page_id == 5).count("again.") == 3000
    assert block_labeller.extract(pages.limit(0), labeller).collect() == []


ARTICLE = "<article><h1>Fish soup</h1><p>One long sentence about food.<p>Two is moreover here.{}</article><footer>&copy; me</footer>"


def test_pages_without_end_of_head(spark, labeller):
    """</head>, <body> and <html> may be left out; nothing of the article is lost by it."""
    starts = ["<html><head><title>no</title><body>", "<html><head><title>no</title>", "<head><meta charset=utf-8><title>no</title><style>p{}</style>",
              "<title>no</title>", "<html><head><title>no</title><noscript><img src=/t></noscript><script>x</script><body>",
              "<html><head><title>no<body>", "<html><head><template><p>no</p></template><title>no <b>x</b></title></head><body>"]
    pages = spark.createDataFrame([(i, "u", x + ARTICLE.format("")) for i, x in enumerate(starts)], "page_id long, url string, html string")
    got = block_labeller.extract(pages, labeller).collect()
    assert [r.text for r in sorted(got)] == ["Fish soup One long sentence about food. Two is moreover here."] * len(starts)
    assert block_labeller.read_page("<html><head><title>t</title>Bare text", {}) == [("Bare text", 1, 0)]


def test_embedded_parts_are_classified(spark, labeller):
    """Text of embedded parts is a block like any other; only what is not content never gets to the labeller."""
    parts = ["<noscript><p>Three words of prose for everyone.</p></noscript>", "<object data=/o><p>Three words of prose for everyone.</p></object>",
             "<p>Three <math><mi>words</mi></math> of prose for everyone.</p>"]
    pages = spark.createDataFrame([(i, "u", f"<html><body>{ARTICLE.format(x)}") for i, x in enumerate(parts)], "page_id long, url string, html string")
    got = block_labeller.extract(pages, labeller).collect()
    assert [r.text for r in sorted(got)] == [
        "Fish soup One long sentence about food. Two is moreover here. Three words of prose for everyone."] * len(parts)

    def blocks(html):
        return [b[0] for b in block_labeller.read_page(html, {})]

    assert blocks("<p>a<svg><title>b</title><text>c</text></svg>d<canvas>e</canvas>f<iframe>g</iframe>") == list("abcdefg")
    assert blocks("<p>H<math><msub><mi></mi><mn>2</mn></msub></math>O <p>x") == ["H2O", "x"]
    assert blocks("<style>a</style><script>b</script><template><p>c</template><title>d</title>e") == ["e"]
    paths = {}
    same = block_labeller.read_page("<p>a<noscript>b</noscript>c", paths)
    assert same[0][1] == same[2][1] != same[1][1]


def test_labeller_on_unseen_layouts(labeller):
    pages, labels, paths = block_labeller.generated(200, seed=77)
    rows = block_labeller.block_vectors(pages, paths)
    edge = np.cumsum([0, *map(len, pages)])
    found = labeller.is_main([rows[i:j] for i, j in zip(edge, edge[1:])])
    assert np.mean(np.concatenate(found) == np.concatenate(labels)) > 0.95


def test_long_pages_part_by_part(labeller, monkeypatch):
    r = np.random.default_rng(3)
    pages = [r.random((n, block_labeller.WIDTH), np.float32) for n in (0, 1, 30, 31, 64, 65, 200, 500)]
    plain = [labeller.forward(p[:, None], np.ones((len(p), 1), np.float32))[0][:, 0] for p in pages]
    monkeypatch.setattr(block_labeller, "CELLS", 64)
    assert all(np.array_equal(a, b > 0) for a, b in zip(labeller.is_main(pages), plain))
    assert np.allclose(labeller.long_page(500, lambda low, high: pages[-1][low:high]), plain[-1], atol=1e-4)


def test_a_page_of_very_many_blocks_among_small_ones(labeller):
    """Memory stays bounded, and every page gets the text it has alone."""
    import tracemalloc

    article = "<body><nav><a href=x>Menu</a></nav><article>" + "".join(
        f"<p>Sentence number {i} of a long article, which goes on for some words.</p>" for i in range(3)) + "</article></body>"
    long = "<body><article>" + "<p>ab</p>" * 100_000 + "</article></body>"
    tracemalloc.start()
    together = block_labeller.main_texts([long, *[article] * 255], labeller)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    assert together[0] == block_labeller.main_texts([long], labeller)[0]
    assert set(together[1:]) == set(block_labeller.main_texts([article], labeller))


def test_labeller_on_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in block_labeller.extract(pages, block_labeller.train(pages)).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1|br)[^>]*>", article)]
        assert got[r.page_id] == " ".join(filter(None, parts))


def test_structure_of_no_text():
    empty = quality_machine.features(pa.array(["", None]), np.zeros((2, 1)))
    assert np.diff(empty[2]).tolist() == [quality_machine.STATS + 1] * 2
