"""Ad-hoc reports: one row per URL, one row per text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.operators import risk, rules, spam_model
from mailgrain.params import DEFAULTS, Params
from mailgrain.sources.workspace import stored


def analyse_urls(
    urls: DataFrame,
    hops: DataFrame | None = None,
    intel: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Level, score and the first three recommendations of each distinct URL."""
    distinct = urls.select("url").distinct().withColumn("uid", F.col("url"))
    tables = hops is not None or intel is not None
    found = risk.url_reports(distinct, hops, intel, params) if tables else None
    scored = risk.score_urls(distinct, found, params)
    return scored.select(
        "url", "overall_risk_level", "overall_risk_score",
        F.slice("recommendations", 1, 3).alias("recommendations"))


def url_verdicts(
    urls: DataFrame,
    hops: DataFrame | None = None,
    intel: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """The full verdict of each distinct URL: structure, phishing, redirects and intel nested, score, level, advice.

    A null URL has one too, of nulls and the least risk.
    """
    distinct = urls.select("url").distinct().withColumn("uid", F.col("url"))
    found = stored(risk.url_reports(distinct, hops, intel, params), "reports")
    scored = risk.score_urls(distinct, found, params, details=risk.DETAILS)
    return scored.select("url", *risk.verdict_columns(scored))


def check_texts(
    texts: DataFrame,
    text: str = "text",
    model: spam_model.SpamModel | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Preview, prediction, confidence, gate and threshold of each text."""
    return rules.score_messages(spam_model.predict(texts, model, text, params), text, params)
