"""Multinomial naive Bayes by counting: sums that can be merged, and scoring as a join.

What is learned is a table of class-conditional term weights.  Such tables of
several parts of the training rows add up to that of all of them, so a model can
be kept up to date by counting the new rows alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.operators import tfidf
from mailgrain.operators.voting import single_vote
from mailgrain.params import DEFAULTS, Params


def partial_sums(vectors: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """label, term, weight, docs: summed weights of each class and term; the row without term has the class's size.

    Rows of other labels than 0 and 1 do not count.  Sums are made map-side first,
    so a term sends one row for each task and class.
    """
    known = vectors.where(F.col(label).isin(0, 1))
    items = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight"))), F.col(vector))
    return known.select(F.col(label).cast("int").alias("label"), F.explode(items).alias("t")).groupBy(
        "label", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight"), F.count(F.lit(1)).alias("docs"))


def merged(*parts: DataFrame) -> DataFrame:
    """The partial sums of all parts together; each row of documents must be in one part only."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("label", "term").agg(F.sum("weight").alias("weight"), F.sum("docs").alias("docs"))


def log_odds(sums: DataFrame, vocabulary: DataFrame, smoothing: float = DEFAULTS.smoothing_alone) -> DataFrame:
    """term, odds: the logarithm of spam's likelihood of each term of the vocabulary over ham's.

    The row without term has the log ratio of the class sizes, null if a class has
    no rows.  A class's likelihood of a term is its summed weight plus the
    smoothing, over the sum for all terms.
    """
    of = lambda c, name: F.sum(F.when(F.col("label") == c, F.col(name)))
    totals = sums.agg(
        *[F.coalesce(of(c, "weight"), F.lit(0.0)).alias(f"w{c}") for c in (0, 1)],
        *[F.sum(F.when(F.col("term").isNull() & (F.col("label") == c), F.col("docs"))).alias(f"n{c}") for c in (0, 1)]).first()
    size = vocabulary.count()
    by_term = sums.where("term is not null").groupBy("term").agg(of(0, "weight").alias("ham"), of(1, "weight").alias("spam"))
    part = lambda name, total: F.ln(
        (F.coalesce(F.col(name), F.lit(0.0)) + F.lit(smoothing)) / F.lit(total + smoothing * size))
    terms = vocabulary.select("term").join(by_term, "term", "left").select(
        "term", (part("spam", totals["w1"]) - part("ham", totals["w0"])).alias("odds"))
    both = bool(totals["n0"] and totals["n1"])
    classes = sums.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("term"),
        (F.ln(F.lit(float(totals["n1"])) / F.lit(float(totals["n0"]))) if both else F.lit(None).cast("double")).alias("odds"))
    return terms.unionByName(classes)


def scores(
    vectors: DataFrame, odds: DataFrame, key: str, vector: str = "vector", params: Params = DEFAULTS
) -> DataFrame:
    """key, p_spam, prediction and confidence of each vector.

    Terms are joined with the model, one row for each term of the vocabulary, and
    their weighted odds summed by document.  Terms the model does not know add
    nothing, so an empty vector gets the shares of the classes.
    """
    prior = odds.where("term is null").select(F.col("odds").alias("_prior"))
    exploded = vectors.select(key, F.explode_outer(vector).alias("t")).select(
        key, F.col("t.term").alias("term"), F.col("t.weight").alias("_weight"))
    joined = exploded.join(tfidf.sent(odds.where("term is not null"), params), "term", "left")
    summed = joined.groupBy(key).agg(F.coalesce(F.sum(F.col("_weight") * F.col("odds")), F.lit(0.0)).alias("_odds"))
    # One row, so this is no product of tables.
    total = summed.crossJoin(F.broadcast(prior)).withColumn(
        "p_spam", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_odds") + F.col("_prior")))))
    prediction, confidence = single_vote(F.col("p_spam"))
    return total.select(key, "p_spam", prediction.alias("prediction"), confidence.alias("confidence"))
