"""Long keyword lists: one automaton per task reads every text once, in Arrow batches.

The unrolled expressions of ``functions.text`` search once per keyword, which is
the better form for a few dozen; here the time does not depend on their number.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _is_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def _automaton(keywords: Sequence[str]):
    known = ahocorasick.Automaton()
    for n, keyword in enumerate(keywords):
        if keyword:
            known.add_word(keyword, n)
    known.make_automaton()
    return known


def _bounded(text: str, start: int, end: int, wordy: tuple[bool, bool]) -> bool:
    """Whether text[start:end] stands between word boundaries; ``wordy``: its first and last character are of words."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != wordy[0] and after != wordy[1]


def _per_text(result: Callable, spark_type, keywords: Sequence[str]):
    """A UDF on lower-case texts; the automaton is built once per task."""

    @F.pandas_udf(spark_type)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _automaton(keywords)
        wordy = [(bool(re.match(r"\w", k)), bool(re.search(r"\w\Z", k))) for k in keywords]
        sizes = [len(k) for k in keywords]
        empty = len(known) == 0

        def found(text: str) -> Iterator[tuple[int, int]]:
            return iter(()) if empty or not text else known.iter(text)

        for texts in batches:
            yield texts.map(lambda text: result(text or "", found, wordy, sizes))

    return apply


def _whole_words(text: str, found, wordy, sizes) -> int:
    count, free = 0, {}
    for last, n in found(text):
        start = last + 1 - sizes[n]
        if start >= free.get(n, 0) and _bounded(text, start, last + 1, wordy[n]):
            free[n] = last + 1
            count += 1
    return count


def _held(text: str, found, wordy, sizes) -> list[int]:
    return sorted({n for _, n in found(text)})


def _distinct(keywords: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(keywords))


def keyword_count(lowered: Column, keywords: Iterable[str]) -> Column:
    """Whole-word occurrences of all keywords, summed; null text has none.

    Equals :func:`mailgrain.functions.text.keyword_count` with each keyword
    listed once: occurrences of one keyword do not overlap, and keywords are
    counted apart from each other.  Empty keywords never occur.
    """
    words = _distinct(k.lower() for k in keywords)
    return _per_text(_whole_words, LongType(), words)(lowered)


def held_keywords(lowered: Column, keywords: Iterable[str]) -> Column:
    """Array of the keywords that a text contains anywhere, in list order, once each; null text has none.

    Empty keywords never occur.
    """
    words = _distinct(keywords)
    held = _per_text(_held, ArrayType(IntegerType()), words)(lowered)
    listed = F.from_json(F.lit(json.dumps(words)), "array<string>")  # one constant, however long
    return F.transform(held, lambda n: F.get(listed, n))


def mimicked_names(host: Column, names: Iterable[str], ending: str = ".com") -> Column:
    """The listed names that a lower-case host holds without ending in the name and ``ending``."""
    return F.filter(held_keywords(host, names), lambda n: ~host.endswith(F.concat(n, F.lit(ending))))
