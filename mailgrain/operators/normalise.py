"""Text normalisation for the models: native cleaning, stemming in Arrow batches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions.stemming import stem_tokens
from mailgrain.functions.text import SPACE, SPACE_SET, TAG, WORD_CHAR
from mailgrain.params import DEFAULTS, JOINED_FORMS, Params

URL = r"https?://[!$-_a-z]+"
NOT_SPACE = f"[^{SPACE_SET}]"
# A match always starts at the beginning of a blank-free run, so looking only
# there finds the same addresses in linear time.
ADDRESS = rf"(?:\A|(?<={SPACE})){NOT_SPACE}+@{NOT_SPACE}+"
JOINED = f"(?<!{WORD_CHAR})(?:" + "|".join(
    f"{pair.split()[0]}(?={pair.split()[1]}(?!{WORD_CHAR}))" for pair in JOINED_FORMS.values()
) + ")"
QUOTES = "«“‘„»”’"
# Most tokens begin with a plain letter, which is found without the Unicode classes.
TOKEN = f"[a-z]++[^{SPACE_SET}{QUOTES}]*+|[{QUOTES}]|[^{SPACE_SET}{QUOTES}]++"
# ASCII punctuation and all digits.
MARKS = r"[!-/:-@\[-`{-~\p{Nd}]+"


def clean(text: Column) -> Column:
    """Lower case without tags, URLs, addresses, ASCII punctuation and digits."""
    out = F.regexp_replace(F.lower(text), TAG, "")
    out = F.regexp_replace(out, URL, "")
    out = F.when(text.contains("@"), F.regexp_replace(out, ADDRESS, "")).otherwise(out)
    return F.regexp_replace(out, MARKS, "")


def tokens(cleaned: Column, params: Params = DEFAULTS) -> Column:
    """Blank-separated tokens without stop words, in text order; quotes stand alone."""
    held = reduce(or_, (cleaned.contains(form) for form in JOINED_FORMS))
    parted = F.when(held, F.regexp_replace(cleaned, JOINED, "$0 ")).otherwise(cleaned)
    words = F.regexp_extract_all(parted, F.lit(TOKEN), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*params.stop_words))
    return F.coalesce(kept, F.array().cast("array<string>"))


def with_tokens(messages: DataFrame, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    # A column of its own, for the tokens read the cleaned text several times.
    cleaned = messages.withColumn("_cleaned", clean(F.col(text)))
    return cleaned.withColumn("tokens", tokens(F.col("_cleaned"), params)).drop("_cleaned")


def normalise(
    messages: DataFrame, text: str = "text", out: str = "processed_text", params: Params = DEFAULTS
) -> DataFrame:
    """Add the normalised text; null text becomes empty."""
    return with_tokens(messages, text, params).withColumn(
        out, stem_tokens("tokens")).drop("tokens")
