"""Text predicates and counters as native column expressions.

Every pattern here spells out its Unicode character classes, so the result does
not depend on what a regex engine takes ``\\s``, ``\\d`` or ``\\b`` to mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"
# All Unicode white space, and the four ASCII separators 0x1c-0x1f.
SPACE_SET = r"\p{IsWhite_Space}\x1c-\x1f"
SPACE = f"[{SPACE_SET}]"
TAG = r"<[^>]+>"


def portable(pattern: str) -> str:
    """Replace the shorthands ``\\s`` and ``\\d`` by explicit Unicode classes."""
    inside = pattern.replace(r"[\s-]", f"[{SPACE_SET}-]")
    return inside.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def _literal(pattern: str) -> str | None:
    """The text a pattern stands for if it holds no regex operators."""
    bare = re.sub(r"\\\W", "", pattern)
    if re.fullmatch(r"[\w ,'-]*", bare):
        return re.sub(r"\\(\W)", r"\1", pattern)
    return None


def _needle(pattern: str) -> str | None:
    """The longest literal text that every match must contain, or None."""
    count = r"(?:[?*]|\{[^}]*\})"
    variable = rf"(?:\([^)]*\)|\[[^\]]*\]|\\[A-Za-z]){count}?|(?:\\\W|[^\\]){count}"
    solid = re.sub(variable, "\0", pattern)
    if "|" in solid:
        return None
    runs = [re.sub(r"\\(\W)", r"\1", run) for run in re.split("[\0+*?]+", solid)]
    return max(runs, key=len) or None


def quoted(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def occurs(text: str, pattern: str) -> str:
    """SQL predicate: ``pattern`` matches anywhere in the column ``text``.

    Literal patterns become ``contains``; the others run the regex only on rows
    that contain the longest literal text the pattern requires.
    """
    literal = _literal(pattern)
    if literal is not None:
        return f"contains({text}, {quoted(literal)})"
    matched = f"{text} RLIKE {quoted(portable(pattern))}"
    needle = _needle(pattern)
    return matched if needle is None else f"(contains({text}, {quoted(needle)}) AND {matched})"


def any_occurs(text: str, patterns: Iterable[str]) -> Column:
    return F.expr(" OR ".join(occurs(text, p) for p in patterns) or "false")


def weigh(signs: Iterable[tuple[str, int]]) -> Column:
    """Sum of the points of all SQL predicates that hold."""
    return F.expr(" + ".join(
        f"CASE WHEN {sign} THEN {worth} ELSE 0 END" for sign, worth in signs) or "0")


def names_of(signs: Iterable[tuple[str, str]]) -> Column:
    """Array of the names of all SQL predicates that hold, in the given order."""
    cases = ", ".join(f"CASE WHEN {sign} THEN {quoted(name)} END" for sign, name in signs)
    return F.array_compact(F.expr(f"array({cases})").cast("array<string>"))


def occurrence_points(text: str, patterns: Iterable[str]) -> Column:
    """One point for each pattern that matches at least once."""
    return weigh((occurs(text, p), 1) for p in patterns)


def whole_word(keyword: str) -> str:
    """Regex for ``keyword`` between word boundaries.

    The keyword comes first and the look-behind repeats it, so the engine can
    search for plain text before it tests a boundary.
    """
    literal = re.escape(keyword)
    before = "(?<!" if re.match(r"\w", keyword) else "(?<="
    after = "(?!" if re.search(r"\w\Z", keyword) else "(?="
    return f"{literal}{before}{WORD_CHAR}{literal}){after}{WORD_CHAR})"


def keyword_count(lowered: str, keywords: Iterable[str]) -> Column:
    """Whole-word occurrences of all keywords, summed; the column holds lower case."""

    def hits(keyword: str) -> str:
        needle = keyword.lower()
        return (f"CASE WHEN contains({lowered}, {quoted(needle)}) "
                f"THEN regexp_count({lowered}, {quoted(whole_word(needle))}) ELSE 0 END")

    return F.expr(" + ".join(hits(k) for k in keywords) or "0")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def uppercase_ratio(text: Column) -> Column:
    lowerless = F.length(F.regexp_replace(text, r"\p{IsUppercase}+", ""))
    return (F.length(text) - lowerless) / F.greatest(F.length(text), F.lit(1))


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks; a text without any at its ends is not searched."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")).otherwise(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def preview(text: Column, width: int = 100) -> Column:
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)
