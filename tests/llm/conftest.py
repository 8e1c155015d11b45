import pytest
from pyspark.sql import functions as F


@pytest.fixture
def table(spark):
    """Documents with columns whose names the operators use themselves."""
    def make(rows):
        own = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {c: F.lit("x") for c in ("chunk", "n", "bucket", "run", "place", "word", "score", "kept", "order")}
        return own.withColumns(extra)

    return make
