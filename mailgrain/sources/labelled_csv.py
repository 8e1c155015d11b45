"""Reader for labelled text in CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cell texts that mean "missing".
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
LABELS = {"ham": 0, "spam": 1}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text.  Quoted texts may hold line breaks, so each file is read in
    one task; where they do not, pass ``multi_line=False`` to split large files."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)


def prepare(rows: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rename ``v1, v2`` to ``label, text``, map labels to 0/1, drop rows of other labels and incomplete ones.

    ``subset`` names the columns that must be present; by default all, so one
    empty extra column drops every row.
    """
    if {"v1", "v2"} <= set(rows.columns):
        rows = rows.withColumnsRenamed({"v1": "label", "v2": "text"})
    filled = rows.select(*[
        F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns])
    label = reduce(lambda out, kind: out.when(F.col("label") == kind, LABELS[kind]), LABELS, F)
    return filled.withColumn("label", label).na.drop("any", subset=list(subset) if subset else None)


def load_labelled(
    spark: SparkSession, path: str, subset: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    return prepare(read_csv(spark, path, multi_line), subset)
