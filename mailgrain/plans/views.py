"""Mail-shaped views of the driver's tables, used by the registered queries.

Every view reads whole tables.  The word lists are the defaults plus words that
occur in these tables, so that each rule has something to find.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain import params as P
from mailgrain.functions import text as tx
from mailgrain.functions import urls as ux

TEXT_TABLES = ("documents", "pages", "conversations")
AS_OF = datetime(2024, 1, 31)
SPREAD: int | None = None
BRACKET_HOSTS = ("[::1]", "a[b].com", "me@[1:2::3]:80", "[x]", "[::ffff:1.2.3.4]", "[1.2.3.4]", "[v1.a]", "x.com][y.com", "[1:2:3:4:5:6:7:8]", "[::1]x")

CHECK = replace(
    P.DEFAULTS,
    spam_keywords=P.SPAM_KEYWORDS + ("worthless", "stupid", "that", "the of"),
    ham_keywords=P.HAM_KEYWORDS + ("license", "with"),
    money_patterns=P.MONEY_PATTERNS + (r"\d+\)\s*\d+",),
    urgency_patterns=P.URGENCY_PATTERNS + (r"token\s+=", r"worthless"),
    opt_out_patterns=P.OPT_OUT_PATTERNS + (r"all\s+rights", r"license"),
    unsubscribe_patterns=P.UNSUBSCRIBE_PATTERNS + (r"all[\s-]?rights",),
    disposable_senders=P.DISPOSABLE_SENDERS + ("de.example", "spam-farm"),
    reputable_senders=P.REPUTABLE_SENDERS + ("en.example",),
    suspicious_tlds=P.SUSPICIOUS_TLDS + (".net",),
    trusted_names=P.TRUSTED_NAMES + ("example",),
    phishing_keywords=P.PHISHING_KEYWORDS + ("casino", "pills", "adult", "stupid"),
    popular_hosts=P.POPULAR_HOSTS + ("thther.example.org", "www.ththed.example.com"),
    unsubscribe_url_words=P.UNSUBSCRIBE_URL_WORDS + ("cheap", "utm_source"),
    days_back=7,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole table; with SPREAD set, text tables are dealt over that many tasks first.

    That is for measurements on one-file tables only: it shuffles the texts.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.repartition(SPREAD) if SPREAD and name in TEXT_TABLES else rows


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as plain mails, pages as newsletters that quote their URL."""
    doc, page = table(spark, folder, "documents"), table(spark, folder, "pages")
    host = F.lower(ux.split_url(F.col("url")).netloc)
    offers = F.when(
        F.col("url").contains("?"),
        F.concat(F.lit("<mailto:leave@"), host, F.lit(">, <"), "url", F.lit(">")))
    mails = doc.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uid"),
        F.col("doc_id").alias("seq"),
        F.concat("source", F.col("doc_id").cast("string"), F.lit("@"), "lang",
                 F.lit(".example.com")).alias("sender"),
        F.col("source").alias("subject"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("list_unsubscribe"))
    letters = page.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("uid"),
        F.col("page_id").alias("seq"),
        F.concat(F.lit("news@"), host).alias("sender"),
        host.alias("subject"),
        F.concat(tx.strip_tags(F.col("html")), F.lit(" "), "url").alias("content"),
        offers.alias("list_unsubscribe"))
    return mails.unionByName(letters).withColumns({
        "received_date": F.lit(AS_OF).cast("timestamp"),
        "error": F.lit(None).cast("string"),
    })


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("url")


def probe_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs, and one URL per event whose host tries a number form or a trick."""
    event = table(spark, folder, "events")
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    num = n.cast("string")
    kind = n % 6
    host = (
        F.when(kind == 0, F.concat(user, F.lit("."), (n % 300).cast("string"), F.lit(".1.2")))
        .when(kind == 1, F.concat(F.lit("0x"), F.lower(F.hex(n)), F.lit("."), user))
        .when(kind == 2, F.concat(F.lit("www.0"), user, F.lit("."), num))
        .when(kind == 3, (n * 1000003).cast("string"))
        .when(kind == 4, F.concat(F.substring(F.md5("props"), 1, 12), F.lit(".a.b.c.bit.ly")))
        .otherwise(F.concat(F.lit("PayPal.g"), F.when(n % 4 == 1, F.lit("о")).otherwise("o"),
                            F.lit("ogle"), user, F.lit(".tk")))
    )
    made = F.concat(F.lit("http://"), host, F.lit("/"), F.md5("props"), F.lit(";v=1?q="), num)
    return event.select(made.alias("url")).unionByName(page_urls(spark, folder))


def bracket_urls(spark: SparkSession, folder: str) -> DataFrame:
    """One URL per event with a bracketed host, every second one valid."""
    n = F.col("event_id")
    host = F.element_at(F.array(*map(F.lit, BRACKET_HOSTS)), (n % len(BRACKET_HOSTS) + 1).cast("int"))
    return table(spark, folder, "events").select(F.concat(F.lit("http://"), host, F.lit("/"), n.cast("string")).alias("url"))


def redirect_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Pages answer with the next page, a relative step, a loop, nothing, or 200."""
    page = table(spark, folder, "pages").select("page_id", "url")
    other = page.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url"))
    n = F.col("page_id")
    to = page.withColumn("to_id", F.when(n % 40 == 6, n - 2).otherwise(n + 1))
    linked = to.join(other, "to_id", "left")
    parts = ux.split_url(F.col("url"))
    origin = F.concat(parts.scheme, F.lit("://"), parts.netloc)
    aside = F.concat(F.lit("/moved/"), n.cast("string"))
    final = (n % 8 == 7) | F.col("to_url").isNull()
    location = (
        F.when(final | (n % 50 == 12), F.lit(None).cast("string"))
        .when(n % 16 == 9, F.concat(F.lit("../x/./../.."), aside))
        .otherwise(F.col("to_url")))
    direct = linked.select(
        "url",
        F.when(final, 200).when(n % 40 == 6, 302).otherwise(301).alias("status"),
        location.alias("location"))
    moved = linked.where(n % 16 == 9).select(
        F.concat(origin, aside).alias("url"), F.lit(308).alias("status"),
        F.col("to_url").alias("location"))
    return direct.unionByName(moved)


def intel_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A report of three engines for two of three pages."""
    page = table(spark, folder, "pages").where(F.col("page_id") % 3 != 0)
    n = F.col("page_id")
    engine = lambda hit: F.struct(hit.alias("detected"))
    return page.select(
        "url",
        (n % 20).alias("positives"),
        F.when(n % 7 == 0, 0).otherwise(60).cast("bigint").alias("total"),
        F.lit(AS_OF).cast("timestamp").alias("scan_date"),
        F.lit(None).cast("string").alias("permalink"),
        F.create_map(
            F.lit("alpha"), engine(n % 2 == 0), F.lit("beta"), engine(n % 5 == 0),
            F.lit("gamma"), engine(F.lit(None).cast("boolean"))).alias("scans"))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What requesting an unsubscribe URL gave."""
    n = F.col("page_id")
    return table(spark, folder, "pages").where(n % 11 != 10).select(
        "url",
        F.when(n % 5 == 0, F.lit(None).cast("int")).when(n % 5 == 1, 404).otherwise(200).alias("status"),
        F.when(n % 5 == 0, "timed out").alias("error"))


def mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an inbox listing."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("uid"), F.col("event_id").alias("seq"),
        F.col("user_id").alias("mailbox"), F.col("ts").cast("timestamp").alias("received_date"))


def processed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as processing history."""
    n = F.col("event_id")
    spam = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        n.cast("string").alias("uid"), F.col("user_id").cast("string").alias("sender"),
        F.col("event_type").alias("subject"), F.col("ts").cast("timestamp").alias("processed_date"),
        spam.alias("is_spam"), F.least(F.col("value") / 500, F.lit(1.0)).alias("spam_confidence"),
        (n % 2 == 0).alias("has_unsubscribe"), (spam & (n % 2 == 0)).alias("unsubscribe_attempted"),
        (spam & (n % 4 == 0)).alias("unsubscribe_successful"),
        (n % 4).cast("int").alias("url_count"), (n % 2).cast("int").alias("high_risk_urls"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Unsubscribe attempts of the error events, two for every third."""
    event = table(spark, folder, "events").where("event_type = 'error'")
    n = F.col("event_id")
    tries = F.when(n % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return event.where(n % 2 == 0).select(
        n.cast("string").alias("email_uid"), F.col("user_id").cast("string").alias("sender"),
        F.explode(tries).alias("k"), (n % 4 == 0).alias("success"),
    ).withColumn("unsubscribe_url", F.concat(
        F.lit("https://example.org/u/"), "email_uid", F.lit("/"), F.col("k").cast("string")))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One processing session per day of events."""
    done = processed(spark, folder)
    seconds = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("uid"), "value")
    return done.join(seconds, "uid").groupBy(F.to_date("processed_date").alias("day")).agg(
        F.count(F.lit(1)).alias("total_processed"), F.sum("value").alias("processing_time")
    ).withColumn("session_date", F.col("day").cast("timestamp"))


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    doc, label = table(spark, folder, "documents"), table(spark, folder, "labels")
    return doc.join(label, "doc_id").select(
        "doc_id", "text", F.col("toxic").alias("label"))


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with three pseudo-probabilities, some missing."""
    n = F.col("doc_id").cast("string")

    def p(name: str):
        digits = F.substring(F.md5(F.concat(n, F.lit(name))), 1, 6)
        return F.conv(digits, 16, 10).cast("double") / F.lit(16777216.0)

    scored = table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").alias("label"), p("naive_bayes").alias("naive_bayes"),
        p("random_forest").alias("random_forest"), p("logistic_regression").alias("logistic_regression"))
    k = F.col("doc_id")
    gap = F.lit(None).cast("double")
    return scored.withColumns({
        "random_forest": F.when(k % 5 == 0, gap).otherwise(F.col("random_forest")),
        "naive_bayes": F.when(k % 35 == 0, gap).otherwise(F.col("naive_bayes")),
        "logistic_regression": F.when(k % 70 == 0, gap).otherwise(F.col("logistic_regression")),
    })
