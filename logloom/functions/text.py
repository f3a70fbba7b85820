"""Tokens of a message."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two or more word characters in a row.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens in order, without the stop words (English by default)."""
    words = english_stop_words() if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(words)) if words else found
