"""Hosts and texts against long lists, compared with plain forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mailgrain import params as P
from mailgrain.functions import keywords as kw
from mailgrain.functions import text as tx
from mailgrain.operators import host_lists
from mailgrain.operators import url_scoring as us
from mailgrain.plans.catalogue import QUERIES


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, host, times):
    letters = list(host)
    for _ in range(times):
        i = rng.randrange(len(letters) + 1)
        rng.choice([lambda: letters.insert(i, rng.choice("qé.")), lambda: letters and letters.pop(i - 1),
                    lambda: letters and letters.__setitem__(i - 1, rng.choice("xw"))])()
    return "".join(letters)


@pytest.fixture(scope="module")
def made_hosts():
    """Listed hosts of all lengths (short and long ones too) and hosts up to five edits away from them."""
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choice("abcde") for _ in range(rng.randint(low, high)))
    listed = [word(0, 7) + rng.choice(["", ".com", ".io"]) for _ in range(60)]
    listed += [f"{word(1, 5)}.{word(20, 70)}.org" for _ in range(20)] + list(P.POPULAR_HOSTS) + ["", "a", "ab"]
    hosts = [edited(rng, rng.choice(listed), rng.randint(0, 5)) for _ in range(500)] + listed
    return sorted(set(hosts)), sorted(set(listed))


@pytest.mark.parametrize("edits,gap,most", [(3, 2, 1_000_000), (3, 3, 0), (2, 2, 0), (1, 1, 1_000_000)])
def test_near_hosts_match_brute_force(spark, made_hosts, edits, gap, most):
    hosts, listed = made_hosts
    rows = spark.createDataFrame([(h,) for h in hosts + hosts[:50]] + [(None,)], "host string")
    targets = spark.createDataFrame([(t,) for t in listed + listed[:9]] + [(None,)], "target string")
    found = host_lists.near_hosts(rows, targets, edits, gap, broadcast_keys=most)
    got = sorted(tuple(r) for r in found.collect())
    want = sorted((h, t, distance(h, t)) for h in hosts for t in listed
                  if abs(len(h) - len(t)) <= gap and 1 <= distance(h, t) <= edits)
    assert got == want
    plan = plan_of(found)
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_near_hosts_make_their_keys_in_compiled_code(spark):
    """No key of a host is made by an interpreted lambda, and probed URLs are not split once more to drop malformed ones."""
    hosts, targets = (spark.createDataFrame([("bit.ly",), (None,)], f"{c} string") for c in ("host", "target"))
    lines = plan_of(host_lists.near_hosts(hosts, targets)).splitlines()
    assert [line for line in lines if "explode" in line and "_host" in line]
    assert not [line for line in lines if "_host" in line and "lambda" in line]
    query = plan_of(QUERIES["near_hosts"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in query.splitlines() if "Filter" in line and "Contains(regexp_extract" in line]


def test_near_hosts_refuse_more_edits(spark):
    rows = spark.createDataFrame([], "host string")
    with pytest.raises(ValueError):
        host_lists.near_hosts(rows, rows, 4, target="host")


def test_near_hosts_against_a_hundred_thousand(spark):
    """Equal to measuring every pair for some of the hosts, and few pairs are measured."""
    made = spark.range(100_000).select(F.concat(
        F.substring(F.md5(F.col("id").cast("string")), 1, (F.lit(5) + F.col("id") % 8).cast("int")),
        F.element_at(F.array(*map(F.lit, (".com", ".org", ".net", ".co.uk"))), (F.col("id") % 4 + 1).cast("int"))).alias("target"))
    # One listed host in 500, with its first character doubled and its third changed.
    hosts = made.where(F.crc32("target") % 500 == 0).select(F.concat(
        F.substring("target", 1, 2), F.lit("~"), F.expr("substring(target, 4)"), F.lit("")).alias("host"))
    got = {tuple(r) for r in host_lists.near_hosts(hosts, made).collect()}
    sample = {r[0] for r in hosts.orderBy("host").limit(5).collect()}
    near = F.levenshtein("host", "target", 3)
    every = hosts.where(F.col("host").isin(*sample)).distinct().crossJoin(made.distinct()).where(
        (F.abs(F.length("host") - F.length("target")) <= 2) & near.between(1, 3)).select("host", "target", near)
    assert {g for g in got if g[0] in sample} == {tuple(r) for r in every.collect()}
    assert {h for h, _, _ in got} == {r[0] for r in hosts.collect()}


def test_near_targets_equal_the_literal_form(spark, made_hosts):
    hosts, _ = made_hosts
    rows = spark.createDataFrame([(n, h) for n, h in enumerate(hosts + hosts[:20] + [None])], "n int, host string")
    popular = spark.createDataFrame([(p,) for p in P.POPULAR_HOSTS], "target string")
    literal = rows.select("n", F.array_sort(tx.names_of((us.typosquat("host", p), p) for p in P.POPULAR_HOSTS)).alias("t"))
    found = host_lists.with_near_targets(rows, popular)
    assert found.columns == ["n", "host", "near_targets"]
    assert {r["n"]: r["near_targets"] for r in found.collect()} == {r["n"]: r["t"] for r in literal.collect()}


def test_longest_suffix(spark):
    listed = [(".uk", 1), ("co.uk", 2), ("Example.CO.uk", 3), ("tk", 4), ("tk", 9), ("", 5), (None, 6), (".", 7)]
    suffixes = spark.createDataFrame(listed, "suffix string, points int")
    want = {"a.co.uk": ("co.uk", 2), "co.uk": ("uk", 1), "x.EXAMPLE.co.uk": ("example.co.uk", 3), "axexample.co.uk": ("co.uk", 2),
            "tk": (None, None), ".tk": ("tk", 4), "a.tk": ("tk", 4), "a.tk:80": (None, None), "": (None, None),
            None: (None, None), "a..uk": ("uk", 1), "a.uk.": (None, None), ".".join("x" * 3000) + ".uk": ("uk", 1)}
    rows = spark.createDataFrame([(h, "k") for h in [*want, "a.tk"]], "host string, points string")
    found = host_lists.with_longest_suffix(rows.withColumnRenamed("points", "own"), suffixes)
    assert found.columns == ["host", "own", "suffix", "points"] and found.count() == len(want) + 1
    assert {r["host"]: (r["suffix"], r["points"]) for r in found.collect()} == want
    none = host_lists.with_longest_suffix(rows.select("host"), suffixes.limit(0))
    assert {r["suffix"] for r in none.collect()} == {None}


def test_suffix_table_equals_the_literal_signs(spark):
    rng = random.Random(5)
    pieces = [*P.SUSPICIOUS_TLDS, ".com", "a", "tk", ".", "work"]
    hosts = {"".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(600)}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffixes = spark.createDataFrame([(t,) for t in P.SUSPICIOUS_TLDS], "suffix string")
    found = host_lists.with_longest_suffix(rows, suffixes)
    got = {r["host"]: r["suffix"] for r in found.collect()}
    for host in hosts:
        held = [t[1:] for t in P.SUSPICIOUS_TLDS if host.endswith(t)]
        assert got[host] == (held[0] if held else None), host
    plan = plan_of(found)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


TEXTS = ["", None, "act now, act now!", "react now", "free free-free free_ free1 ñfree freeé", "no risk no risk no risk", "a a a a a",
         "opt out", "$$$ $5 a$5", "ab" * 30_000 + " free", "loan.loan,loan", "free\nmoney back"]


def test_counts_equal_the_unrolled_form(spark):
    rng = random.Random(2)
    pieces = [*P.SPAM_KEYWORDS, *P.HAM_KEYWORDS, " ", " ", ".", "a a", "a", "$5", "é", "_", "７", "-"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, low string")
    lists = [P.SPAM_KEYWORDS + P.HAM_KEYWORDS, ("a a", "a", "$5", "$", "free", "Free"), (), ("",)]
    for words in lists:
        once = dict.fromkeys(w.lower() for w in words if w)
        got = rows.select("n", kw.keyword_count(F.col("low"), words).alias("c"),
                          F.coalesce(tx.keyword_count("low", once), F.lit(0)).alias("want"))
        assert [r for r in got.where("c <> want OR c IS NULL").collect()] == []


def test_held_keywords_and_mimicked_names(spark):
    words = P.PHISHING_KEYWORDS + ("", "now", "now", "a\0b", "'\"\\")
    rows = spark.createDataFrame([(t,) for t in TEXTS + ["a\0b '\"\\ verify accountnow"]], "low string")
    for r in rows.select("low", kw.held_keywords(F.col("low"), words).alias("k")).collect():
        assert r["k"] == [k for k in dict.fromkeys(words) if k and k in (r["low"] or "")]
    hosts = ["google.com", "xgoogle.com", "google.com.tk", "apple-bank.com", "", None, "paypal.amazon.com"]
    named = spark.createDataFrame([(h,) for h in hosts], "host string").select(
        "host", kw.mimicked_names(F.col("host"), P.TRUSTED_NAMES).alias("m"))
    for r in named.collect():
        host = r["host"] or ""
        assert r["m"] == [n for n in P.TRUSTED_NAMES if n in host and not host.endswith(n + ".com")]


def test_ten_thousand_keywords_in_one_pass(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    words = list(dict.fromkeys(word() for _ in range(60_000)))[:10_000]
    assert len(words) == 10_000
    texts = [" ".join(word() for _ in range(200)) for _ in range(20)]
    known = set(words)
    rows = spark.createDataFrame([(t,) for t in texts], "low string")
    counted = rows.select("low", kw.keyword_count(F.col("low"), words).alias("c"), kw.held_keywords(F.col("low"), words).alias("k"))
    for r in counted.collect():
        assert r["c"] == sum(w in known for w in re.findall(r"\w+", r["low"]))
        assert r["k"] == [w for w in words if w in r["low"]]
    assert "Exchange" not in plan_of(counted)
