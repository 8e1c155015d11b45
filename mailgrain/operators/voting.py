"""Combining class-1 probabilities of several models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgrain.params import ENSEMBLE_WEIGHTS


def total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns, F.lit(0.0))


def single_vote(p_spam: Column) -> tuple[Column, Column]:
    """Prediction and confidence of one model; a tie is class 0."""
    other = F.lit(1.0) - p_spam
    return (p_spam > other).cast("int"), F.greatest(p_spam, other)


def decision_vote(decision: Column) -> tuple[Column, Column]:
    """For a model with a decision value only: its sign, and |d| / (|d| + 1)."""
    size = F.abs(decision)
    return (decision > 0).cast("int"), size / (size + F.lit(1.0))


def soft_vote(p_spam: Mapping[str, Column]) -> tuple[Column, Column]:
    """Unweighted mean of the probabilities."""
    return single_vote(total(p_spam.values()) / F.lit(float(len(p_spam))))


def weighted_vote(
    p_spam: Mapping[str, Column], weights: Mapping[str, float] = ENSEMBLE_WEIGHTS
) -> tuple[Column, Column]:
    """Votes weighted by model weight and confidence.

    A null probability takes the model out of all sums; with no model left the
    prediction is null and the confidence 0.
    """
    votes, sure, mass = [], [], []
    for name, p in p_spam.items():
        weight = F.lit(float(weights.get(name, 1.0)))
        prediction, confidence = single_vote(p)
        present = p.isNotNull()
        part = lambda c, on=present: F.when(on, c).otherwise(F.lit(0.0))
        votes.append(part(prediction * weight * confidence))
        sure.append(part(confidence * weight))
        mass.append(part(weight))
    mass_sum = total(mass)
    prediction = (total(votes) / mass_sum > F.lit(0.5)).cast("int")
    any_model = mass_sum > 0
    return (
        F.when(any_model, prediction),
        F.when(any_model, total(sure) / mass_sum).otherwise(F.lit(0.0)),
    )
