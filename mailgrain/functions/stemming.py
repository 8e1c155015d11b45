"""Porter stemming of token arrays in Arrow batches.

The rules are those of M. F. Porter, "An algorithm for suffix stripping" (1980)
with the later published revisions: short words stay, a few irregular forms are
looked up, and final ``y`` turns into ``i`` only after a consonant that is not
the first letter.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Executors receive these functions by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMO_SIZE = 1 << 17
SLICE_TOKENS = 1 << 18

# Irregular forms and the suffix tables of the algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie",
    "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word with each letter replaced by v (vowel) or c (consonant)."""
    out = []
    for letter in word:
        if letter in "aeiou":
            out.append("v")
        elif letter == "y" and out and out[-1] == "c":
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant-vowel-consonant (not w, x, y), or is vowel-consonant."""
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem != word and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
    return word


def _longest(word: str, suffixes) -> str | None:
    if not word.endswith(tuple(suffixes)):
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


def _swap(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    return stem + table[suffix] if _measure(stem) > 0 else word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, STEP2)


def _residue(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    keep = _measure(stem) <= 1 or (suffix == "ion" and stem[-1:] not in ("s", "t"))
    return word if keep else stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _closed(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(token: str) -> str:
    word = token.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _swap(_derived(word), STEP3)
    return _tidy(_residue(word))


@F.arrow_udf(StringType())
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem every token of each array and join them by one blank.

    A task stems each distinct token once; the memo is emptied when full.  Tokens
    stay Arrow text, of which only the distinct ones of a slice become Python
    objects, so the memory of a task does not grow with the texts of a batch.
    """
    memo: dict[str, str] = {}

    def stemmed(token: str) -> str:
        known = memo.get(token)
        if known is None:
            if len(memo) >= MEMO_SIZE:
                memo.clear()
            known = memo[token] = stem(token)
        return known

    def joined(rows: pa.Array, upto: np.ndarray) -> pa.Array:
        coded = rows.flatten().dictionary_encode()
        stems = pa.array(map(stemmed, coded.dictionary.to_pylist()), coded.dictionary.type)
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), stems.take(coded.indices))
        return pc.binary_join(lists, " ").cast(pa.string())

    for tokens in batches:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        parts, start = [], 0
        while start < len(tokens):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + SLICE_TOKENS, side="right")) - 1)
            parts.append(joined(tokens.slice(start, end - start), upto[start:end + 1] - upto[start]))
            start = end
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
