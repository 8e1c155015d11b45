"""Redirect chains, threat intel, overall risk, and the roll-up per message."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mailgrain import params as P
from mailgrain import schemas
from mailgrain.operators import intel, redirects, risk, unsubscribe
from mailgrain.params import DEFAULTS
from mailgrain.plans import reports
from mailgrain.sources.workspace import stored

HOPS = [
    ("http://end.org", 200, None),
    ("https://a.org/x/y", 302, "../z"), ("https://a.org/z", 301, "http://end.org"),
    ("http://self.org", 301, "http://self.org"),
    ("https://s1.org", 301, "http://p1.org"), ("http://p1.org", 301, "https://s2.org"),
    ("https://s2.org", 307, "http://p2.org"), ("http://p2.org", 308, "https://s3.org"),
    ("https://s3.org", 303, None),
    ("http://empty.org", 301, ""), ("http://lost.org", 301, "http://nowhere.org"),
    ("http://failed.org", None, None), ("http://gone.org", 404, None),
] + [(f"http://n.org/{i}", 301, f"/{i + 1}") for i in range(20)]


def chains(spark, urls):
    hops = spark.createDataFrame(HOPS, schemas.HOPS)
    roots = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = redirects.score_redirects(redirects.follow_redirects(roots, hops)).collect()
    return {r["url"]: r for r in rows}


def follow(url, limit=10):
    """The same walk, one URL at a time."""
    table = {u: (s, loc) for u, s, loc in HOPS}
    seen, current = [], url
    for _ in range(limit):
        if table.get(current, (None, None))[0] is None:
            return None
        status, location = table[current]
        seen.append(current)
        if status not in P.REDIRECT_STATUSES or not location:
            break
        from urllib.parse import urljoin
        current = location if location.startswith("http") else urljoin(current, location)
    return seen, current


def test_chains_match_a_walk(spark):
    urls = [h[0] for h in HOPS] + ["http://unknown.org"]
    got = chains(spark, urls)
    assert len(got) == len(urls)
    for url in urls:
        want, r = follow(url), got[url]
        if want is None:
            assert r["error"] and r["redirect_score"] is None and r["final_url"] is None
        else:
            assert [s["url"] for s in r["chain"]] == want[0]
            assert r["final_url"] == want[1] and r["redirect_count"] == len(want[0]) - 1


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 7, 10])
def test_every_hop_limit_matches_a_walk(spark, limit):
    """Chains put together from longer pieces are those of a walk step by step."""
    to = {i: (i * 7 + 3) % 40 if i % 5 else None for i in range(40)}
    name = lambda i: f"http://w.org/{i}"
    hops = spark.createDataFrame(
        [(name(i), 301 if t is not None else 200, name(t) if t is not None else None) for i, t in to.items() if i % 11 != 6], schemas.HOPS)
    urls = spark.createDataFrame([(name(i),) for i in range(40)], "url string")
    got = redirects.follow_redirects(urls, hops, replace(DEFAULTS, max_redirects=limit)).collect()
    assert len(got) == 40
    for r in got:
        at, walked, failed = int(r["url"].rpartition("/")[2]), [], False
        for _ in range(limit):
            if at % 11 == 6:
                failed = True
                break
            walked.append(name(at))
            if to[at] is None:
                break
            at = to[at]
        assert ([s["url"] for s in r["chain"]], r["final_url"], r["error"]) == (walked, name(at), failed)


def skew_splits(rows):
    rows.write.format("noop").mode("overwrite").save()
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().count("skew=true")


@pytest.fixture
def small_partitions(spark):
    """Settings under which a few thousand rows of one key count as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_candidates_are_split(spark, small_partitions):
    url = F.when(F.col("id") % 5 > 0, "http://hot.org/unsubscribe").otherwise(F.concat(F.lit("http://u.org/"), F.col("id").cast("string")))
    messages = spark.range(0, 20000, 1, 8).select(F.col("id").cast("string").alias("uid"), F.array(url).alias("candidates"))
    outcomes = messages.select(F.explode("candidates").alias("url")).distinct().withColumns(
        {"status": F.lit(200), "error": F.lit(None).cast("string")})
    judged = unsubscribe.judge_candidates(messages, outcomes)
    assert skew_splits(judged) > 0
    assert judged.where("success").count() == 20000


def test_hot_urls_with_reports_are_split(spark, small_partitions):
    url = F.when(F.col("id") % 5 > 0, "http://hot.org/x").otherwise(F.concat(F.lit("http://u.org/"), F.col("id").cast("string")))
    facts = spark.range(0, 20000, 1, 8).select(F.col("id").cast("string").alias("uid"), F.array(url).alias("urls"), F.lit(0).alias("points"))
    found = stored(risk.url_reports(facts.select(F.explode("urls").alias("url")).distinct()), "reports")
    assert skew_splits(risk.summarise_urls(facts, found)) > 0


def test_hot_targets_and_hot_urls(spark):
    """A third of all chains share one target, a third of all messages one URL."""
    n = 3000
    hops = spark.range(n).select(
        F.concat(F.lit("http://r.org/"), F.col("id").cast("string")).alias("url"), F.lit(301).alias("status"),
        F.when(F.col("id") % 3 == 0, "http://hot.org").otherwise("http://end.org").alias("location")
    ).unionByName(spark.createDataFrame(
        [("http://hot.org", 302, "http://end.org"), ("http://end.org", 200, None)], schemas.HOPS))
    hops = hops.unionByName(hops.where("url = 'http://hot.org'"))
    rows = redirects.score_redirects(redirects.follow_redirects(hops.select("url").distinct(), hops))
    counts = {r["redirect_count"]: r["count"] for r in rows.groupBy("redirect_count").count().collect()}
    assert counts == {2: 1000, 1: 2001, 0: 1}
    messages = spark.range(n).select(
        F.col("id").cast("string").alias("uid"),
        F.when(F.col("id") % 3 == 0, "see http://hot.org/ now").when(F.col("id") % 3 == 1, "nothing")
        .otherwise(F.concat(F.lit("see http://r.org/"), F.col("id").cast("string"))).alias("content"))
    facts = risk.url_facts(messages)
    reports_of = risk.url_reports(spark.createDataFrame([("http://hot.org/",)], "url string"), hops)
    got = risk.summarise_urls(facts, reports_of)
    assert got.count() == n and got.where("urls_found = 0").count() == 1000


def test_no_cartesian_products(spark):
    hops = spark.createDataFrame(HOPS, schemas.HOPS)
    rows = spark.createDataFrame([("m", "http://a.tk")], "uid string, content string")
    reports_of = risk.url_reports(hops.select("url"), hops)
    plan = risk.summarise_messages(rows, reports_of)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_chain_scores(spark):
    got = chains(spark, ["http://end.org", "http://self.org", "https://s1.org", "http://n.org/0", "http://lost.org"])
    facts = lambda u: (got[u]["redirect_score"], got[u]["redirect_flags"], got[u]["redirect_level"])
    assert facts("http://end.org") == (0, [], "low")
    assert facts("http://self.org") == (5, ["excessive_redirects", "redirect_loop"], "high")
    assert facts("https://s1.org") == (
        8, ["multiple_domain_redirects", "https_downgrade", "https_downgrade"], "high")
    assert facts("http://n.org/0") == (2, ["excessive_redirects"], "low")
    assert got["http://n.org/0"]["final_url"] == "http://n.org/10"
    assert got["http://lost.org"]["redirect_score"] is None
    assert got["http://end.org"]["chain"][0]["final"] is True


def test_intel_levels(spark):
    detected = {"a": (True,), "b": (False,), "c": (None,)}
    rows = [(f"u{i}", p, t, None, None, detected if i == 0 else None)
            for i, (p, t) in enumerate([(0, 0), (0, 60), (1, 60), (3, 60), (12, 60), (5, 0)])]
    table = spark.createDataFrame(rows, schemas.INTEL)
    urls = spark.createDataFrame([(f"u{i}",) for i in range(7)], "url string")
    got = {r["url"]: r for r in intel.attach_intel(urls, table).collect()}
    assert [got[f"u{i}"]["intel_level"] for i in range(6)] == ["clean", "clean", "low", "medium", "high", "clean"]
    assert got["u3"]["intel_risk"] == pytest.approx(5.0) and got["u5"]["intel_risk"] == 0.0
    assert got["u0"]["detected_engines"] == ["a"] and sorted(got["u0"]["clean_engines"]) == ["b", "c"]
    assert got["u6"]["intel_status"] == "not_found" and got["u0"]["intel_status"] == "scanned"
    assert intel.attach_intel(urls, None).first()["intel_status"] == "skipped"


def test_overall_risk(spark):
    cases = [
        # structure, phishing, redirect, intel, level
        (None, None, None, None, "minimal"), (0, 2, 0, 0.0, "minimal"), (0, 2, 1, 0.0, "low"),
        (10, 0, 0, None, "medium"), (0, 10, 5, 0.0, "high"), (0, 15, 5, None, "critical"),
        (20, 20, 0, 100.0, "critical"),
        # 0.3 * 3 + 0.1 stays just below 1 in double arithmetic.
        (3, 0, 0, 10.0, "minimal"),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "s int, p int, r int, i double")
    score = risk.overall_risk(F.col("s"), F.col("p"), F.col("r"), F.col("i"))
    got = rows.select(score.alias("x"), risk.level_name(risk.risk_rank(score)).alias("l")).collect()
    for (s, p, r, i, level), row in zip(cases, got):
        total = (s or 0) * 0.3 + (p or 0) * 0.4 + (r or 0) * 0.2 + ((i or 0) / 100) * 10 * 0.1
        assert row["x"] == min(total, 10.0) and row["l"] == level


def test_message_summary(spark):
    rows = spark.createDataFrame([
        ("none", "no links here"),
        ("one", "see http://plain.org/ for news"),
        ("bad", "urgent winner: act now, click here, bitcoin! http://paypal-login.tk/URGENT-winner-" + "a" * 20),
        ("null", None),
    ], "uid string, content string")
    got = {r["uid"]: r for r in risk.summarise_messages(rows).collect()}
    for empty in ("none", "null"):
        r = got[empty]
        assert (r["urls_found"], r["highest_risk_level"], r["max_risk_score"]) == (0, "none", None)
        assert r["summary"] == "No URLs found in email content" and r["high_risk_urls"] == []
    assert got["one"]["summary"] == "Found 2 URLs. No high-risk URLs detected."
    bad = got["bad"]
    # The bare-domain search finds the host of the full URL again.
    assert bad["urls_found"] == 2 and len(bad["high_risk_urls"]) >= 1
    assert bad["highest_risk_level"] in ("high", "critical")
    assert f"{len(bad['high_risk_urls'])} high-risk URLs detected." in bad["summary"]


def test_summary_does_not_depend_on_partitioning(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("uid"),
        F.concat(F.lit("winner http://a"), (F.col("id") % 7).cast("string"), F.lit(".tk/x www.b.top"))
        .alias("content"))
    one = risk.summarise_messages(rows.repartition(1)).orderBy("uid").collect()
    many = risk.summarise_messages(rows.repartition(13)).orderBy("uid").collect()
    assert one == many


def test_url_report_keeps_three_recommendations(spark):
    urls = spark.createDataFrame([("http://1.2.3.4.bit.ly/winner-urgent-bitcoin-deposit",), ("http://a.org",)], "url string")
    hops = spark.createDataFrame([("http://a.org", 200, None)], schemas.HOPS)
    got = {r["url"]: r for r in reports.analyse_urls(urls, hops).collect()}
    assert got["http://a.org"]["recommendations"] == list(P.ADVICE_BY_LEVEL["minimal"])
    assert all(len(r["recommendations"]) <= 3 for r in got.values())


def test_verdicts_keep_null_urls(spark):
    """With and without lookups a null URL has one row, and other rows stay as they are alone."""
    urls = spark.createDataFrame([(None,), ("https://a.org/x/y",), (None,)], "url string")
    hops, reported = spark.createDataFrame(HOPS, schemas.HOPS), spark.createDataFrame(
        [("https://a.org/x/y", 6, 60, None, None, {"e": (True,)})], schemas.INTEL)
    for tables in ((None, None), (hops, reported), (hops, None), (None, reported)):
        got = {r["url"]: r for r in reports.url_verdicts(urls, *tables).collect()}
        assert set(got) == {None, "https://a.org/x/y"}
        assert got[None]["overall_risk_level"] == "minimal" and got[None]["threat_intel"]["risk_score"] is None
        alone = reports.url_verdicts(urls.where("url is not null"), *tables).collect()
        assert [got["https://a.org/x/y"]] == alone


@pytest.mark.parametrize("lookups", [False, True])
def test_analyses_of_messages(spark, lookups):
    """The summary is the plain one; each analysis is the URL's verdict plus the content's points; in the order of extraction."""
    rows = spark.createDataFrame([
        ("a", "winner www.second.tk and http://self.org then https://a.org/x/y twice https://a.org/x/y"),
        ("b", "see https://a.org/x/y"), ("c", "nothing"), ("d", None), ("e", "http://x.com][ and http://n.org/3"),
    ], "uid string, content string").repartition(3)
    found = None
    if lookups:
        urls = spark.createDataFrame([(u,) for u, _, _ in HOPS], "url string")
        found = stored(risk.url_reports(urls, spark.createDataFrame(HOPS, schemas.HOPS), spark.createDataFrame(
            [("http://self.org", 6, 60, None, None, {"e": (True,)})], schemas.INTEL)), "reports")
    got = {r["uid"]: r for r in risk.analyse_messages(rows, found).collect()}
    plain = {r["uid"]: r for r in risk.summarise_messages(rows, found).collect()}
    assert {u: r[:-1] for u, r in got.items()} == {u: tuple(r) for u, r in plain.items()}
    assert [a["url"] for a in got["a"]["analyses"]] == [
        "http://self.org", "https://a.org/x/y", "https://www.second.tk", "https://www.second", "https://self.org"]
    assert got["c"]["analyses"] == got["d"]["analyses"] == []
    one = got["b"]["analyses"][0]
    assert one["structure_analysis"]["domain"] == "a.org" and one["phishing_check"]["indicators"] == []
    first = got["a"]["analyses"][0]
    assert "content_keyword_winner" in first["phishing_check"]["indicators"]
    if lookups:
        assert first["redirect_analysis"]["redirect_flags"][:1] == ["excessive_redirects"]
        assert (first["threat_intel"]["status"], first["threat_intel"]["detected_engines"]) == ("scanned", ["e"])
        assert one["redirect_analysis"]["final_url"] == "http://end.org"
    else:
        assert first["threat_intel"]["status"] == "skipped"
    for r in got.values():
        assert r["max_risk_score"] == max((a["overall_risk_score"] for a in r["analyses"]), default=None)
