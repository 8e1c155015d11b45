"""Rule-based spam scoring: every feature is a native column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import text as tx
from mailgrain.params import DEFAULTS, Params


def with_lowered(messages: DataFrame, text: str) -> DataFrame:
    """Add ``_low`` once, for all rules that ignore case."""
    return messages.withColumn("_low", F.lower(text))


def suspicious_score(text: str, lowered: str, params: Params = DEFAULTS) -> Column:
    """Points for shouting, money, shorteners, urgency, odd characters and gaps."""
    t = F.col(text)
    shouting = (
        F.when(tx.count_char(t, "!") > 3, 1).otherwise(0)
        + F.when(tx.uppercase_ratio(t) > F.lit(0.3), 2).otherwise(0)
        + F.when(t.rlike("[A-Z]{4,}"), 1).otherwise(0))
    patterns = tx.occurrence_points(
        lowered, params.money_patterns + params.shortener_patterns + params.urgency_patterns)
    odd = F.when(F.octet_length(t) != F.length(t), 0.5).otherwise(0.0)
    gaps = F.when(t.rlike(tx.SPACE + "{5,}"), 0.5).otherwise(0.0)
    return shouting + patterns + (odd + gaps)


def opt_out_score(lowered: str, params: Params = DEFAULTS) -> Column:
    return tx.occurrence_points(lowered, params.opt_out_patterns)


def sender_score(sender: str, params: Params = DEFAULTS) -> Column:
    """Points for disposable or machine-made addresses, less reputable hosts."""
    low = f"lower({sender})"
    holds = lambda host: f"contains({low}, {tx.quoted(host)})"
    raised = tx.weigh([
        *((holds(d), 2) for d in params.disposable_senders),
        (tx.occurs(low, r"[a-z]{1,2}\d{3,}@"), 1),
        (tx.occurs(low, r"\d{5,}@"), 1)])
    lowered = tx.weigh((holds(d), 1) for d in params.reputable_senders)
    return F.greatest(raised - lowered, F.lit(0))


def offers_unsubscribe(lowered: str, header: str, params: Params = DEFAULTS) -> Column:
    """A non-empty List-Unsubscribe header, or wording that offers a way out."""
    wording = tx.any_occurs(lowered, params.unsubscribe_patterns)
    return F.coalesce(F.col(header) != "", F.lit(False)) | F.coalesce(wording, F.lit(False))


def rule_features(
    messages: DataFrame,
    text: str = "content",
    sender: str | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Add the six rule features; null text counts as zero everywhere."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return with_lowered(messages, text).withColumns({
        "spam_keywords": tx.keyword_count("_low", params.spam_keywords),
        "ham_keywords": tx.keyword_count("_low", params.ham_keywords),
        "suspicious_patterns": F.coalesce(suspicious_score(text, "_low", params), F.lit(0.0)),
        "unsubscribe_patterns": opt_out_score("_low", params),
        "sender_reputation": sender_score(sender, params) if sender else F.lit(0),
        "text_length": zero(F.length(tx.strip(F.col(text)))),
    }).drop("_low")


def score_rules(
    messages: DataFrame,
    text: str = "content",
    sender: str | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Add ``rule_is_spam``, ``rule_confidence``, ``rule_score`` and the features.

    Null text is not spam, with confidence 0 and a null score.
    """
    features = rule_features(messages, text, sender, params)
    by_length = (
        F.when(F.col("text_length") < 50, F.lit(1.0))
        .when(F.col("text_length") > 1000, F.lit(-0.5))
        .otherwise(F.lit(0.0))
    )
    score = (
        F.col("spam_keywords") * 2 + F.col("suspicious_patterns")
        + F.col("sender_reputation") - F.col("ham_keywords") * F.lit(1.5)
        - F.col("unsubscribe_patterns") * F.lit(0.5) + by_length
    )
    scored = features.withColumn("rule_score", F.when(F.col(text).isNotNull(), score))
    confidence = F.greatest(
        F.least(F.abs("rule_score") / F.lit(5.0), F.lit(1.0)), F.lit(0.1))
    known = F.col("rule_score").isNotNull()
    return scored.withColumns({
        "rule_is_spam": F.coalesce(
            F.col("rule_score") > F.lit(params.spam_score_threshold), F.lit(False)),
        "rule_confidence": F.when(known, confidence).otherwise(F.lit(0.0)),
    })


def predict_by_rules(
    messages: DataFrame, text: str = "content", params: Params = DEFAULTS
) -> DataFrame:
    """Add ``prediction`` (0/1) and ``confidence``; the sender is not used."""
    scored = score_rules(messages, text, None, params)
    return scored.select(
        *messages.columns,
        F.col("rule_is_spam").cast("int").alias("prediction"),
        F.col("rule_confidence").alias("confidence"),
    )


def spam_gate(prediction: Column, confidence: Column, threshold: float) -> Column:
    """Spam only when predicted so with enough confidence; unknown is not spam."""
    return F.coalesce((prediction == 1) & (confidence >= F.lit(threshold)), F.lit(False))


def score_messages(
    predicted: DataFrame, text: str = "content", params: Params = DEFAULTS
) -> DataFrame:
    """Preview, prediction, confidence and gate for each predicted message."""
    gate = spam_gate(F.col("prediction"), F.col("confidence"), params.confidence_threshold)
    return predicted.withColumns({
        "text_preview": tx.preview(F.col(text)),
        "is_spam": gate,
        "threshold": F.lit(params.confidence_threshold),
    })
