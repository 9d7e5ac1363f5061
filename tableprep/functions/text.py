"""Text keys and similarity scores for fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(c: Column) -> Column:
    """Lower case, with runs of other characters than letters, marks and digits of any script as one space."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{M}\p{N}]+", " "))


def token_sort_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text_key(c), " ")), " ")


def token_set_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(text_key(c), " "))), " ")


KEYS = {"ratio": text_key, "token_sort": token_sort_key, "token_set": token_set_key}


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def score(a: Column, b: Column) -> Column:
    return F.round(100 * similarity(a, b)).cast("int")
