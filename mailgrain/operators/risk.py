"""Overall URL risk, advice, and the roll-up per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import urls as ux
from mailgrain.operators import intel as ti
from mailgrain.operators import redirects as rd
from mailgrain.operators import url_scoring as us
from mailgrain.params import (
    ADVICE_BY_LEVEL, ADVICE_IP_HOST, ADVICE_PHISHING, ADVICE_SHORTENER, DEFAULTS, Params,
)

LEVELS = ("minimal", "low", "medium", "high", "critical")


def overall_risk(structure: Column, phishing: Column, redirect: Column, intel: Column) -> Column:
    """Weighted sum of the parts, capped at 10; a missing part adds nothing."""
    part = lambda c: F.coalesce(c, F.lit(0))
    raw = (
        part(structure) * F.lit(0.3) + part(phishing) * F.lit(0.4)
        + part(redirect) * F.lit(0.2)
        + F.coalesce(intel, F.lit(0.0)) / F.lit(100.0) * F.lit(10.0) * F.lit(0.1)
    )
    return F.least(raw, F.lit(10.0))


def risk_rank(score: Column) -> Column:
    """1 (minimal) to 5 (critical)."""
    return F.when(score >= 7, 5).when(score >= 5, 4).when(score >= 3, 3).when(score >= 1, 2).otherwise(1)


def level_name(rank: Column) -> Column:
    name = F.when(rank == 1, LEVELS[0])
    for n, level in enumerate(LEVELS[1:], start=2):
        name = name.when(rank == n, level)
    return name


def recommendations(level: Column, structure_flags: Column, phishing_level: Column) -> Column:
    """Advice for the level, then for the shortener, IP-host and phishing findings."""
    texts = lambda key: F.array(*[F.lit(t) for t in ADVICE_BY_LEVEL[key]])
    by_level = (
        F.when(level.isin("critical", "high"), texts("severe"))
        .when(level == "medium", texts("medium"))
        .when(level == "low", texts("low"))
        .otherwise(texts("minimal")))
    extra = F.array_compact(F.array(
        F.when(F.array_contains(structure_flags, "url_shortener"), F.lit(ADVICE_SHORTENER)),
        F.when(F.array_contains(structure_flags, "ip_address_domain"), F.lit(ADVICE_IP_HOST)),
        F.when(phishing_level == "high", F.lit(ADVICE_PHISHING))))
    return F.concat(by_level, extra)


def url_reports(
    urls: DataFrame,
    hops: DataFrame | None = None,
    intel: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Redirect and threat-intel results of distinct URLs; absent parts are null."""
    if hops is None:
        chained = urls.select("url").withColumns({
            "redirect_score": F.lit(None).cast("int"),
            "redirect_level": F.lit(None).cast("string"),
            "final_url": F.lit(None).cast("string"),
        })
    else:
        chained = rd.score_redirects(rd.follow_redirects(urls, hops, params)).drop("error")
    return ti.attach_intel(chained, intel)


def spread_key() -> Column:
    """The URL, or a unique never-matching key so that null URLs do not pile up."""
    return F.coalesce(F.col("url"), F.concat(F.lit("\x00"), F.col("uid").cast("string")))


#: What a report may have besides the parts that count for the risk.
DETAILS = ("redirect_count", "final_url", "chain", "redirect_flags", "redirect_level",
           "intel_level", "positives", "total", "detected_engines", "clean_engines")


def with_reports(occurrences: DataFrame, reports: DataFrame | None = None, details: tuple[str, ...] = ()) -> DataFrame:
    """Attach the per-URL reports to every occurrence of the URL, with those details that they have.

    Without reports no shuffle is needed at all.  With them, the occurrences
    are the left side of one join with a table that is unique on the key, so
    the adaptive skew join can split a URL that very many messages share.
    """
    if reports is None:
        return occurrences.withColumns({
            "redirect_score": F.lit(None).cast("int"),
            "intel_risk": F.lit(None).cast("double"),
            "intel_status": F.lit("skipped"),
        })
    keyed = reports.select(
        F.col("url").alias("_key"), "redirect_score", "intel_risk", "intel_status", *[d for d in details if d in reports.columns])
    return occurrences.withColumn("_key", spread_key()).join(keyed, "_key", "left").drop("_key")


def score_urls(
    occurrences: DataFrame,
    reports: DataFrame | None = None,
    params: Params = DEFAULTS,
    content_points_col: str | None = None,
    content_indicators_col: str | None = None,
    flags: bool = True,
    details: tuple[str, ...] = (),
) -> DataFrame:
    """Full verdict of each URL row: the four parts, overall score, level, advice.

    ``reports`` comes from :func:`url_reports`; of it ``details`` are kept.
    """
    parts = us.with_url_parts(with_reports(occurrences, reports, details))
    scored = us.score_phishing(
        us.score_structure(parts, params, flags), params,
        content_points_col, content_indicators_col, flags)
    overall = scored.withColumn("overall_risk_score", overall_risk(
        F.col("structure_score"), F.col("phishing_score"),
        F.col("redirect_score"), F.col("intel_risk")))
    ranked = overall.withColumn("risk_rank", risk_rank(F.col("overall_risk_score")))
    levelled = ranked.withColumn("overall_risk_level", level_name(F.col("risk_rank")))
    if not flags:
        return levelled
    return levelled.withColumn("recommendations", recommendations(
        F.col("overall_risk_level"), F.col("structure_flags"), F.col("phishing_level")))


def verdict_columns(scored: DataFrame) -> list[Column]:
    """Structure, phishing, redirects and intel of scored URLs as nested columns, then score, level and advice."""
    own = lambda *names: [c for c in names if c in scored.columns]
    return [
        *us.url_report_columns(),
        F.struct(*own("redirect_count", "final_url", "chain"), F.col("redirect_score").alias("score"),
                 *own("redirect_flags", "redirect_level")).alias("redirect_analysis"),
        F.struct(F.col("intel_status").alias("status"), F.col("intel_risk").alias("risk_score"),
                 *own("intel_level", "positives", "total", "detected_engines", "clean_engines")).alias("threat_intel"),
        F.col("overall_risk_score"), F.col("overall_risk_level"), F.col("recommendations")]


def url_facts(messages: DataFrame, text: str = "content", params: Params = DEFAULTS) -> DataFrame:
    """``uid, urls, points``: all that the URL summary needs of a message."""
    lowered = messages.select("uid", text, F.lower(text).alias("_low"))
    return lowered.select(
        "uid", ux.extract_urls(F.col(text)).alias("urls"),
        us.content_points("_low", params).alias("points"))


def summarise_messages(
    messages: DataFrame,
    reports: DataFrame | None = None,
    params: Params = DEFAULTS,
    text: str = "content",
) -> DataFrame:
    """URL summary per message; messages without URLs get level ``none``."""
    return summarise_urls(url_facts(messages, text, params), reports, params)


def _message_scores(facts: DataFrame, reports: DataFrame | None, params: Params) -> DataFrame:
    """``uid, url, score, rank`` per message and URL; one row of nulls without URLs.

    The content points travel with the exploded rows as one small integer; the
    text itself never enters a shuffle.
    """
    occurrences = us.explode_urls(facts, "urls", keep=("points",))
    scored = score_urls(occurrences, reports, params, "points", flags=False)
    present = F.col("url").isNotNull()
    return scored.select(
        "uid", "url", F.when(present, F.col("overall_risk_score")).alias("score"),
        F.when(present, F.col("risk_rank")).alias("rank"))


def count_urls(
    facts: DataFrame, reports: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """``uid, urls_found, high_risk_urls``: counts only, in one hash aggregate."""
    return _message_scores(facts, reports, params).groupBy("uid").agg(
        F.count("url").cast("int").alias("urls_found"),
        F.count(F.when(F.col("rank") >= 4, 1)).cast("int").alias("high_risk_urls"))


def summarise_urls(
    facts: DataFrame, reports: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """URL summary per row of :func:`url_facts`.

    Rows of one message stay in one task until the group-by, so map-side
    aggregation sends one narrow row each.
    """
    return _summary(_message_scores(facts, reports, params).groupBy("uid").agg(*_summary_sums()))


def analyse_messages(
    messages: DataFrame,
    reports: DataFrame | None = None,
    params: Params = DEFAULTS,
    text: str = "content",
) -> DataFrame:
    """The URL summary per message and ``analyses``, the full verdict of each of its URLs in the order of extraction.

    ``reports`` comes from :func:`url_reports`.  URLs are scored where the text is
    read (with reports, after one join on the URL), and only a message's own
    verdicts are put together.  A message without URLs has no analyses.  Uids must
    be unique.
    """
    lowered = messages.select("uid", text, F.lower(text).alias("_low"))
    facts = lowered.select(
        "uid", ux.extract_urls(F.col(text)).alias("urls"), us.content_points("_low", params).alias("points"),
        us.content_indicators("_low", params).alias("indicators"))
    occurrences = facts.select("uid", "points", "indicators", F.posexplode_outer("urls").alias("pos", "url"))
    scored = score_urls(occurrences, reports, params, "points", "indicators", details=DETAILS)
    present = F.col("url").isNotNull()
    rows = scored.select(
        "uid", "url", F.when(present, F.col("overall_risk_score")).alias("score"), F.when(present, F.col("risk_rank")).alias("rank"),
        F.when(present, F.struct("pos", F.struct("url", *verdict_columns(scored)).alias("verdict"))).alias("_analysis"))
    grouped = rows.groupBy("uid").agg(*_summary_sums(), F.sort_array(F.collect_list("_analysis")).alias("_analyses"))
    return _summary(grouped, F.transform("_analyses", lambda a: a["verdict"]).alias("analyses"))


def _summary_sums() -> list[Column]:
    return [
        F.count("url").cast("int").alias("urls_found"),
        F.max("score").alias("max_risk_score"),
        F.avg("score").alias("average_risk_score"),
        F.max("rank").alias("_rank"),
        F.sort_array(F.collect_list(F.when(F.col("rank") >= 4, F.col("url")))).alias("high_risk_urls"),
    ]


def _summary(grouped: DataFrame, *more: Column) -> DataFrame:
    found, bad = F.col("urls_found"), F.size("high_risk_urls")
    bad_text = F.when(bad > 0, bad.cast("string")).otherwise(F.lit("No"))
    summary = F.when(found == 0, F.lit("No URLs found in email content")).otherwise(
        F.concat(F.lit("Found "), found.cast("string"), F.lit(" URLs. "), bad_text,
                 F.lit(" high-risk URLs detected.")))
    return grouped.select(
        "uid", "urls_found", "max_risk_score", "average_risk_score",
        F.coalesce(level_name(F.col("_rank")), F.lit("none")).alias("highest_risk_level"),
        "high_risk_urls", summary.alias("summary"), *more)
