"""URL structure and phishing scores as native expressions on a URL column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import text as tx
from mailgrain.functions import urls as ux
from mailgrain.params import DEFAULTS, Params

# A sign: SQL predicate on the columns of a URL row, points, and reported name.
Sign = tuple[str, int, str]


def _points(signs: list[Sign]) -> Column:
    return tx.weigh((sign, worth) for sign, worth, _ in signs)


def _names(signs: list[Sign]) -> Column:
    return tx.names_of((sign, name) for sign, _, name in signs)


def with_urls(messages: DataFrame, text: str = "content", out: str = "urls") -> DataFrame:
    """Add the array of distinct URLs of the text; null text has none."""
    return messages.withColumn(out, ux.extract_urls(F.col(text)))


def explode_urls(messages: DataFrame, urls: str = "urls", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per message and distinct URL; a message without any keeps one null row."""
    return messages.select("uid", *keep, F.explode_outer(urls).alias("url"))


def distinct_urls(urls: DataFrame) -> DataFrame:
    """Every URL once; duplicates are dropped map-side before the shuffle."""
    return urls.where(F.col("url").isNotNull()).select("url").distinct()


def with_url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    parts = ux.split_url(F.col(url))
    return urls.withColumns({
        "scheme": parts.scheme, "netloc": parts.netloc, "path": parts.path,
        "query": parts.query, "fragment": parts.fragment,
        "malformed": F.coalesce(parts.malformed, F.lit(False)),
    }).withColumn("host", F.lower("netloc"))


def structure_signs(params: Params = DEFAULTS) -> list[Sign]:
    """Structural signs on ``host``, ``path`` and ``ip_host``, in report order."""
    held = lambda part: f"contains(host, {tx.quoted(part)})"
    ends = lambda part: f"endswith(host, {tx.quoted(part)})"
    return [
        *((ends(tld), 2, f"suspicious_tld_{tld}") for tld in params.suspicious_tlds),
        ("ip_host", 3, "ip_address_domain"),
        (tx.occurs("host", r"\d{3,}"), 1, "numeric_domain"),
        ("size(split(host, '[.]')) > 4", 1, "excessive_subdomains"),
        ("host RLIKE '[0-9a-f]{8,}'", 2, "hex_domain"),
        (" OR ".join(held(s) for s in params.shortener_hosts) or "false", 2, "url_shortener"),
        ("path RLIKE '[a-zA-Z0-9]{20,}'", 1, "random_path"),
        *((f"{held(name)} AND NOT {ends(name + '.com')}", 3, f"mimics_{name}")
          for name in params.trusted_names),
    ]


def keyword_signs(column: str, kind: str, worth: int, params: Params = DEFAULTS) -> list[Sign]:
    """Phishing keywords in a lower-case column."""
    return [(f"contains({column}, {tx.quoted(k)})", worth, f"{kind}_keyword_{k}")
            for k in params.phishing_keywords]


def typosquat(host: str, popular: str) -> str:
    """Predicate: length within two, and one to three edits away from a popular host."""
    near = f"length({host}) BETWEEN {len(popular) - 2} AND {len(popular) + 2}"
    return f"({near} AND levenshtein({host}, {tx.quoted(popular)}, 3) BETWEEN 1 AND 3)"


def trick_signs(params: Params = DEFAULTS) -> list[Sign]:
    """Look-alike letters in the lower-case URL, and near misses of popular hosts."""
    return [
        (f"_url_low RLIKE '[{params.lookalike_letters}]'", 3, "homograph_attack"),
        *((typosquat("host", p), 4, f"typosquat_{p}") for p in params.popular_hosts),
    ]


def level_of_signs(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def score_structure(parts: DataFrame, params: Params = DEFAULTS, flags: bool = True) -> DataFrame:
    """Add ``structure_score`` (null when malformed) and optionally the flags."""
    bare = F.replace("host", F.lit("www."), F.lit(""))
    signs = structure_signs(params)
    added = {"structure_score": F.when(~F.col("malformed"), _points(signs))}
    if flags:
        added["structure_flags"] = F.when(~F.col("malformed"), _names(signs))
    return parts.withColumn("ip_host", ux.is_ipv4_literal(bare)).withColumns(added).drop("ip_host")


def content_points(lowered: str, params: Params = DEFAULTS) -> Column:
    """Phishing points of a lower-case text; computed once per message, not per URL."""
    return _points(keyword_signs(lowered, "content", 1, params))


def content_indicators(lowered: str, params: Params = DEFAULTS) -> Column:
    return _names(keyword_signs(lowered, "content", 1, params))


def score_phishing(
    parts: DataFrame,
    params: Params = DEFAULTS,
    content_points_col: str | None = None,
    content_indicators_col: str | None = None,
    flags: bool = True,
) -> DataFrame:
    """Add ``phishing_score``, ``phishing_level`` and optionally the indicators.

    All three are null when the URL is malformed, so it adds nothing later.
    """
    source = parts.withColumn("_url_low", F.lower("url"))
    keywords, tricks = keyword_signs("_url_low", "url", 2, params), trick_signs(params)
    from_content = F.col(content_points_col) if content_points_col else F.lit(0)
    usable = ~F.col("malformed")
    added = {"phishing_score": F.when(usable, _points(keywords + tricks) + from_content)}
    if flags:
        middle = [F.col(content_indicators_col)] if content_indicators_col else []
        added["phishing_indicators"] = F.when(
            usable, F.concat(_names(keywords), *middle, _names(tricks)))
    return source.withColumns(added).withColumn(
        "phishing_level", F.when(usable, level_of_signs(F.col("phishing_score")))).drop("_url_low")


def url_report_columns() -> list[Column]:
    """Structure and phishing results as two nested columns."""
    return [
        F.struct(
            F.col("host").alias("domain"), "path", "query", "fragment", "scheme",
            F.col("structure_score").alias("suspicious_score"),
            F.col("structure_flags").alias("flags"),
        ).alias("structure_analysis"),
        F.struct(
            "phishing_score", F.col("phishing_indicators").alias("indicators"),
            F.col("phishing_level").alias("risk_level"),
        ).alias("phishing_check"),
    ]
