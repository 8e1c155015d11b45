"""Each stage of the pipeline on its own input, against plain versions."""

from collections import Counter

import corpus_pipeline
import pytest
from brute import near_groups, without_strings, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before and after each stage."""
    from mailgrain.sources.workspace import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return [(d.columns, d.collect()) for d in out]


def test_stages(spark, steps):
    columns = steps[0][0]
    assert [c for c, _ in steps[1:-1]] == [columns] * 4
    docs, good, single, clean, mixed, packed = (rows for _, rows in steps)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert set(map(tuple, good)) <= set(map(tuple, docs))
    assert sum(q == 1 and i not in kept for i, q in labels.items()) <= 1
    assert sum(q == 0 and i in kept for i, q in labels.items()) <= 2

    groups = {i: g for i, _, g in near_groups([(r.doc_id, r.text) for r in good])}
    assert sorted(map(tuple, single)) == sorted(tuple(r) for r in good if groups[r.doc_id] == r.doc_id)

    text = {i: kept.decode(errors="ignore") for i, *_, kept in without_strings([(r.doc_id, r.text) for r in single], 100)}
    source = {r.doc_id: (r.lang, r.source) for r in single}
    assert {r.doc_id: (r.lang, r.source) for r in clean} == source
    # Bytes of a cut character may be left in the plain version's neighbours only by chance.
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in clean)

    size = {r.doc_id: len(words(r.text)) for r in clean}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(map(tuple, mixed)) <= set(map(tuple, clean))
    assert abs(sum(size[i] * n for i, n in copies.items()) - sum(size.values())) <= 20 * max(size.values())

    assert sorted((r.doc_id, r.length) for r in packed) == sorted((r.doc_id, size[r.doc_id]) for r in mixed)
    assert all(r.bound >= r.length for r in packed if r.length)


def test_quality_stage_keeps_what_the_classifier_predicts(spark, monkeypatch):
    from mailgrain.llm import quality_machine
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_machine, "train", lambda *a: None)
    monkeypatch.setattr(quality_machine, "score", lambda docs, model, keep: docs.withColumn("score", F.col("doc_id") / 10))
    docs = spark.range(11).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit(1).cast("long").alias("n_chars"))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == [7, 8, 9, 10]


def test_columns_of_the_operators_names(spark, steps):
    """Columns that are named like those of an operator come through each stage with their own values."""
    from pyspark.sql import functions as F

    names = ("score", "kept", "n_bytes", "n_removed", "n_spans", "source_size", "target", "copies", "taken", "positions", "position",
             "_size", "size", "metadata", "label", "chunk", "n", "component_id", "one", "Schedule")
    for (_, stage), (columns, rows), (_, want) in zip(corpus_pipeline.STAGES[:-1], steps, steps[1:]):
        docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
        more = docs.select(*(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names), *docs.columns)
        got = stage(spark, more, SF)
        assert got.columns == more.columns
        got = got.collect()
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(map(tuple, want))
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_copies_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.length_buckets.pack, "__defaults__", (
        *corpus_pipeline.length_buckets.pack.__defaults__[:3], 80, 50))
    docs = spark.createDataFrame([(i % 100, "a b c d") for i in range(300)] + [(None, "a b c d")] * 3, "doc_id long, text string")
    got = corpus_pipeline.pack_documents(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter([*range(100)] * 3 + [None] * 3)
    together = Counter((r.doc_id, r.batch) for r in got)
    assert max(Counter(r.batch for r in got).values()) == 20 and sum(n - 1 for n in together.values()) <= 50


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "length", "bucket", "bound", "padding").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.length, r.bucket, r.bound, r.padding) for r in steps[-1][1])
