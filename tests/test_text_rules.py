"""Rule scorer: golden rows, and brute force with Python's own regex engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mailgrain import params as P
from mailgrain.functions import text as tx
from mailgrain.operators import rules

GOLDEN = [
    # text, spam score, is spam, confidence
    ("Claim your free prize now, dear winner! You won $2,500!!", 5.0, True, 1.0),
    ("Dear all, the minutes of the project meeting are attached.", -3.0, False, 0.6),
    ("URGENT: act now, this offer expires today!!!", 9.0, True, 1.0),
    ("Make money fast from home, 100% free and no risk!!!", 4.0, True, 0.8),
    ("Lunch is at noon, see you in the small room.", 1.0, False, 0.2),
    ("Your invoice for the last order is attached, thank you.", -3.0, False, 0.6),
    ("", 1.0, False, 0.2),
    ("x" * 49, 1.0, False, 0.2),
    ("x" * 50, 0.0, False, 0.1),
    ("x" * 1000, 0.0, False, 0.1),
    ("x" * 1001, -0.5, False, 0.1),
    ("free " + "x" * 60, 2.0, False, 0.4),
    ("free free " + "x" * 60, 4.0, True, 0.8),
    ("carefree freedom " + "x" * 60, 0.0, False, 0.1),
    ("please unsubscribe opt out of this list " + "y" * 40, 3.0, True, 0.6),
    ("gap" + "\t \n \r" + "y" * 60, 0.5, False, 0.1),
    ("é" + "y" * 60, 0.5, False, 0.1),
]


def test_golden_scores(spark):
    rows = spark.createDataFrame(
        [(i, text) for i, (text, *_) in enumerate(GOLDEN)], "id int, content string")
    got = {r["id"]: r for r in rules.score_rules(rows).collect()}
    for i, (text, score, spam, confidence) in enumerate(GOLDEN):
        assert got[i]["rule_score"] == pytest.approx(score), text
        assert got[i]["rule_is_spam"] is spam, text
        assert got[i]["rule_confidence"] == pytest.approx(confidence), text


def test_null_text_is_not_spam(spark):
    rows = spark.createDataFrame([(None,)], "content string")
    row = rules.score_rules(rows).first()
    assert (row["rule_is_spam"], row["rule_confidence"], row["rule_score"]) == (False, 0.0, None)
    assert row["spam_keywords"] == row["ham_keywords"] == row["text_length"] == 0
    assert row["unsubscribe_patterns"] == 0 and row["suspicious_patterns"] == 0.0


def _random_texts(seed, count, pieces):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(count)]


PIECES = [
    "free", "Free", "act now", "act  now", "no risk", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0",
    " ", "​", "_", "-", ".", "é", "ß", "Ä", "АБВ", "५", "5", "100", " dollars", " euro", "$", "!",
    "don't wait", "dont wait", "expires today", "expire soon", "limited time", "limited time",
    "stop emails", "stop-email", "optout", "opt-out", "opt  out", "remove me", "LOUD", "LOUDER", "bit.ly",
    "bitxly", "t.co", "loan", "loans", "́", "Ⓐ", "Ⅷ", "x",
]


def _expected(text):
    low = text.lower()
    count = lambda words: sum(
        len(re.findall(r"\b" + re.escape(w) + r"\b", low)) for w in words)
    hit = lambda patterns: sum(bool(re.search(p, low)) for p in patterns)
    odd = 0.5 * bool(re.search(r"[^\x00-\x7F]", text)) + 0.5 * bool(re.search(r"\s{5,}", text))
    upper = sum(c.isupper() for c in text) / max(len(text), 1)
    suspicious = (
        (text.count("!") > 3) + 2 * (upper > 0.3) + bool(re.search("[A-Z]{4,}", text))
        + hit(P.MONEY_PATTERNS + P.SHORTENER_PATTERNS + P.URGENCY_PATTERNS) + odd)
    offers = any(re.search(p, low) for p in P.UNSUBSCRIBE_PATTERNS)
    return (count(P.SPAM_KEYWORDS), count(P.HAM_KEYWORDS), suspicious,
            hit(P.OPT_OUT_PATTERNS), len(text.strip()), offers)


def test_features_match_brute_force(spark):
    texts = _random_texts(1, 1500, PIECES)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").withColumn(
        "header", F.lit(None).cast("string"))
    offered = rules.with_lowered(rules.rule_features(rows), "content").withColumn(
        "offers", rules.offers_unsubscribe("_low", "header"))
    for r in offered.collect():
        got = (r["spam_keywords"], r["ham_keywords"], r["suspicious_patterns"],
               r["unsubscribe_patterns"], r["text_length"], r["offers"])
        assert got == _expected(texts[r["id"]]), repr(texts[r["id"]])


def test_sender_reputation(spark):
    cases = {
        "ab123@yopmail.com": 3, "12345@temp-mail.org": 3, "x12345@gmail.com": 1, "me@gmail.com": 0,
        "a@company.com.tempmail.net": 1, "abc12345@x.org": 2, None: 0, "AB999@MAILINATOR.com": 3,
    }
    rows = spark.createDataFrame([(s,) for s in cases], "sender string")
    got = rows.select("sender", rules.sender_score("sender").alias("s")).collect()
    assert {r["sender"]: r["s"] or 0 for r in got} == cases


def test_gate_and_preview(spark):
    rows = spark.createDataFrame(
        [("a" * 100, 1, 0.85), ("a" * 101, 1, 0.8499), ("b", 0, 1.0), ("c", None, 0.0)],
        "content string, prediction int, confidence double")
    got = [(r["text_preview"], r["is_spam"], r["threshold"]) for r in rules.score_messages(rows).collect()]
    assert got == [("a" * 100, True, 0.85), ("a" * 100 + "...", False, 0.85),
                   ("b", False, 0.85), ("c", False, 0.85)]


def test_added_keyword_never_lowers_the_score(spark):
    texts = _random_texts(2, 200, PIECES)
    rows = spark.createDataFrame(
        [(t + " " * 1 + "z" * 60, t + " winner" + "z" * 0 + " " + "z" * 60) for t in texts],
        "a string, b string")
    both = rules.score_rules(rows, "a").select("b", F.col("rule_score").alias("before"))
    after = rules.score_rules(both, "b")
    assert after.where("rule_score < before").count() == 0
    assert after.where("rule_confidence not between 0.1 and 1").count() == 0


def test_required_text_of_patterns():
    assert tx._needle(r"\d+\s*dollars?") == "dollar"
    assert tx._needle(r"[a-z]{1,2}\d{3,}@") == "@"
    assert tx._needle(r"\d{3,}") is None
    assert tx._needle("a|b") is None
    assert tx._literal(r"bit\.ly") == "bit.ly"
    assert tx._literal(r"don\'?t\s+wait") is None


def test_rules_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("x", "y")], "content string, sender string")
    plan = rules.score_rules(rows, "content", "sender")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
