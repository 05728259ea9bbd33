"""Scores between 0 and 1 for pairs of comparable columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import literal_map


def tokens(c: Column) -> Column:
    words = F.split(F.lower(c), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def address_tokens(c: Column) -> Column:
    """Tokens with street abbreviations spelled out."""
    spelled = literal_map(V.STREET_ABBREVIATIONS)
    full = F.transform(tokens(c), lambda w: F.coalesce(F.try_element_at(spelled, w), w))
    return F.array_distinct(F.split(F.array_join(full, " "), " "))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def equal_score(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def edit_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def name_score(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    return F.coalesce(F.greatest(jaccard(a_tokens, b_tokens), edit_score(a, b)), F.lit(0.0))
