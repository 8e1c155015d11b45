"""By what rows are dealt into ranges (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_order(rows: DataFrame, id_col: str) -> Column:
    """The md5 of the id as text; for rows without id, of a hash of their other columns.

    Maps cannot be hashed and do not count.  Equal rows without id have one key.
    """
    others = [rows[f"`{f.name}`"] for f in rows.schema if f.name != id_col and "map<" not in f.dataType.simpleString()]
    alone = F.concat(F.lit("null "), F.xxhash64(*others, F.lit(0)).cast("string"))
    return F.md5(F.coalesce(F.col(id_col).cast("string"), alone).cast("binary"))
