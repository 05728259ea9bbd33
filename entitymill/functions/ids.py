"""Deterministic identifiers: the same input row always gets the same id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 12 digits (48 bits) are enough for a laptop table; they collide from about
# 16 million rows on, so tables of unknown size get 32.
ID_DIGITS = 32


def stable_id(prefix: str, *keys: Column, digits: int = ID_DIGITS) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, digits))
