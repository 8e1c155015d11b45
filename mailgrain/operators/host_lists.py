"""Hosts against tables of hosts and of suffixes, of any length; every join is on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where hosts are cut follows their length only.  The last characters of a host
# tell little (".com"), so they are not counted when it is halved; of a half at
# most PIECE characters make keys, which bounds the keys of a host.
ENDING = 4
PIECE = 24


def _cut(length: Column) -> Column:
    """How many characters of a host of that length are its first part."""
    half = F.floor((length - ENDING) / 2).cast("int")
    return F.least(length, F.greatest(half, F.lit(1)))


def _variants(part: Column, deleted: int) -> Column:
    """The text itself and, with ``deleted`` = 1, each form without one of its characters."""
    if deleted == 0:
        return F.array(part)
    return F.transform(
        F.sequence(F.lit(0), F.length(part)),
        lambda i: F.when(i == 0, part).otherwise(
            F.concat(F.substr(part, F.lit(1), i - 1), F.substr(part, i + 1))))


def _keys(side: str, parts: Column, deleted: int) -> Column:
    return F.transform(
        F.flatten(F.transform(parts, lambda p: _variants(p, deleted))),
        lambda v: F.xxhash64(F.lit(side), v))


def _ends(host: Column, size: Column) -> Column:
    """The last ``size`` characters."""
    return F.substr(host, F.length(host) - size + 1)


def _target_keys(target: Column, deleted: int) -> Column:
    """Keys of the first and of the last part of a listed host."""
    cut = _cut(F.length(target))
    first = F.substr(target, F.lit(1), F.least(cut, F.lit(PIECE)))
    last = _ends(target, F.least(F.length(target) - cut, F.lit(PIECE)))
    return F.array_distinct(F.concat(
        _keys("first", F.array(first), deleted), _keys("last", F.array(last), deleted)))


def _with_host_keys(hosts: DataFrame, deleted: int, gap: int) -> DataFrame:
    """A row ``_host, _key`` for all beginnings and ends that the parts of a near target can have become.

    The lengths of these are ranges, for a part grows by at most one character
    with its target.  Rows of numbers are made first and each key is a plain
    expression of one, so Spark compiles it with the join.  Keys may repeat.
    """
    size = F.length("_host")
    shortest, longest = F.greatest(size - gap, F.lit(0)), size + gap

    def low(part_of):
        return F.greatest(F.least(part_of(shortest), F.lit(PIECE)) - deleted, F.lit(0))

    def high(part_of):
        return F.least(F.least(part_of(longest), F.lit(PIECE)) + deleted, size)

    # Ends have numbers below 0, from -1 for the one without a character.
    rest = lambda n: n - _cut(n)
    numbers = F.concat(F.sequence(low(_cut), high(_cut)), F.sequence(-high(rest) - 1, -low(rest) - 1))
    first = F.col("_number") >= 0
    parts = hosts.select("_host", F.explode(numbers).alias("_number")).select(
        "_host", F.when(first, "first").otherwise("last").alias("_side"),
        F.when(first, F.substr("_host", F.lit(1), F.col("_number"))).otherwise(
            _ends(F.col("_host"), -F.col("_number") - 1)).alias("_part"))
    if deleted == 0:
        return parts.select("_host", F.xxhash64("_side", "_part").alias("_key"))
    at = F.col("_at")
    forms = parts.select("*", F.explode(F.sequence(F.lit(0), F.length("_part"))).alias("_at"))
    form = F.when(at == 0, F.col("_part")).otherwise(
        F.concat(F.substr("_part", F.lit(1), at - 1), F.substr("_part", at + 1)))
    return forms.select("_host", F.xxhash64("_side", form).alias("_key"))


def near_hosts(
    hosts: DataFrame,
    targets: DataFrame,
    edits: int = 3,
    length_gap: int = 2,
    host: str = "host",
    target: str = "target",
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """Pairs ``host``, ``target``, ``distance`` that are 1 to ``edits`` (at most 3) edits apart.

    Their lengths differ by at most ``length_gap``.  A target is cut in two; of
    three edits at most one falls into one of the parts, so that part and the
    beginning or end of the host that it became share a form with one character
    deleted.  Pairs that share such a form meet in an equi-join and are then
    measured, so the result is exact.  Each pair comes once; null hosts and
    targets have none, an empty one is text of length 0.

    A list of up to ``broadcast_keys`` forms is broadcast, so that hosts are not
    shuffled but to drop repeats; a longer one is joined by a shuffle.
    """
    if not 1 <= edits <= 3:
        raise ValueError("edits must be 1, 2 or 3")
    deleted, gap = edits // 2, min(length_gap, edits)
    listed = targets.where(F.col(target).isNotNull()).select(F.col(target).alias("_target")).distinct()
    found = hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("_host")).distinct()
    listed = listed.select("_target", F.explode(_target_keys(F.col("_target"), deleted)).alias("_key"))
    found = _with_host_keys(found, deleted, gap)
    if listed.limit(broadcast_keys + 1).count() <= broadcast_keys:
        listed = F.broadcast(listed)
    distance = F.levenshtein("_host", "_target", edits)
    close = F.abs(F.length("_host") - F.length("_target")) <= gap
    met = found.join(listed, "_key").where(close & distance.between(1, edits))
    return met.select("_host", "_target").distinct().select(
        F.col("_host").alias(host), F.col("_target").alias(target), distance.alias("distance"))


def with_near_targets(
    urls: DataFrame, targets: DataFrame, out: str = "near_targets", host: str = "host",
    target: str = "target", **limits: int,
) -> DataFrame:
    """Add the sorted array of listed hosts that a URL's host is a near miss of; empty if none."""
    pairs = near_hosts(urls, targets, host=host, target=target, **limits)
    lists = pairs.groupBy(host).agg(F.array_sort(F.collect_list(target)).alias(out))
    none = F.array().cast("array<string>")
    return urls.join(lists, host, "left").withColumn(out, F.coalesce(out, none)).select(*urls.columns, out)


def longest_suffixes(
    hosts: DataFrame, suffixes: DataFrame, host: str = "host", suffix: str = "suffix"
) -> DataFrame:
    """Each different host that ends in a listed suffix, with the longest one and its other columns.

    A suffix is whole labels after a dot, listed with or without the dot in
    front, in any case; a host is not its own suffix, and null is in no row.
    Of rows that list a suffix twice the least counts.
    """
    others = [c for c in suffixes.columns if c != suffix]
    plain = F.regexp_replace(F.lower(F.col(suffix)), r"\A\.", "")
    listed = suffixes.where(plain != "").groupBy(plain.alias("_suffix")).agg(
        F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
    depth = listed.agg(F.max(F.size(F.split("_suffix", r"\.")))).first()[0] or 0
    found = hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("_host")).distinct()
    labels = F.split(F.lower("_host"), r"\.")
    count = F.least(F.size(labels) - 1, F.lit(depth))
    ends = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(labels, -n, n), ".")))
    met = found.select("_host", F.explode(ends).alias("_suffix")).join(listed, "_suffix")
    best = met.groupBy("_host").agg(F.max_by(F.struct("_suffix", "_row"), F.length("_suffix")).alias("_best"))
    return best.select(
        F.col("_host").alias(host), F.col("_best._suffix").alias(suffix),
        *(F.col(f"_best._row.{c}").alias(c) for c in others))


def with_longest_suffix(
    urls: DataFrame, suffixes: DataFrame, host: str = "host", suffix: str = "suffix"
) -> DataFrame:
    """Add the longest listed suffix of each row's host and its columns; null if it has none."""
    found = longest_suffixes(urls, suffixes, host, suffix)
    return urls.join(found, host, "left").select(*urls.columns, *(c for c in found.columns if c != host))
