"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and the documents its predecessor kept,
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgrain.llm import curriculum, length_buckets, parity_join, quality_machine, suffix_dedup
from mailgrain.llm.catalogue import n_words
from mailgrain.sources.workspace import stored

def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """Documents whose columns other than the needed ones have names that no operator uses, and the way back."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_machine.held_out(F.col("doc_id")))
    docs, own = shielded(docs, "doc_id", "text", "n_chars")
    scored = quality_machine.score(docs, quality_machine.train(docs, labels), keep=tuple(docs.columns))
    return scored.where(F.col("score") >= quality_machine.THRESHOLD).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without id stay."""
    groups = parity_join.near_duplicates(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier, cut at whole characters."""
    docs, own = shielded(docs, "doc_id", "text", "n_chars")
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rows = suffix_dedup.remove_repeats(docs, whole_characters=True, keep=others)
    text = F.col("kept").cast("string")
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order."""
    docs, own = shielded(docs, "doc_id", "text", "source")
    mixed = curriculum.mix(docs.withColumn("_size", n_words("text")), "_size")
    return curriculum.training_order(mixed).select(*own)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every copy of a document, which are dealt apart from each other.

    Documents without id are told apart by a hash of their text.
    """
    copy = F.row_number().over(Window.partitionBy("doc_id", "length", "text_hash").orderBy("length"))
    owner = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_hash").cast("string")))
    sized = docs.select("doc_id", n_words("text").alias("length"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text_hash"))
    sized = sized.withColumn("copy", F.concat_ws(":", owner, copy))
    return length_buckets.pack(stored(sized, "lengths"), id_col="copy").select("doc_id", "length", "bucket", "bound", "batch", "padding")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_documents),
]

#: A fitted classifier is not SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
