"""Names, labels and other plain text columns."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V

# Every character str.strip() removes; Spark's trim() only knows the blank.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column, extra: str = "") -> Column:
    return F.btrim(c, F.lit(WHITESPACE + extra))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


#: Decimal digits of all scripts, and the ASCII digit of each.
DIGITS = "".join(chr(i) for i in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in DIGITS)


def fold_digits(c: Column) -> Column:
    """Digits of any script as ASCII digits."""
    return F.translate(c, DIGITS, ASCII_DIGITS)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL where nothing matches."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def literal_array(values: list[str]) -> Column:
    """Array constant; one literal instead of one per element keeps plans small."""
    return F.split(F.lit("\x02".join(values)), "\x02")


def literal_map(pairs: dict[str, str]) -> Column:
    """Map constant, folded once at planning."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition leaves ASCII behind."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        elif folded:
            longer[ch] = folded
    return "".join(source), "".join(target), longer


def fold_to_ascii(c: Column) -> Column:
    """Compatibility-decompose and keep what is ASCII.

    Plain ASCII rows pay one regex test; characters that decompose into several
    letters are looked up only in the rows that still hold non-ASCII text.
    """
    source, target, longer = _ascii_folds()
    non_ascii = r"[^\x00-\x7F]"
    pairs = literal_map(longer)
    single = F.translate(c, source, target)
    spelled = F.array_join(
        F.transform(F.split(single, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), ""
    )
    several = "[" + "".join(re.escape(ch) for ch in longer) + "]"
    return (
        F.when(~c.rlike(non_ascii), c)
        .when(single.rlike(several), F.regexp_replace(spelled, non_ascii, ""))
        .otherwise(F.regexp_replace(single, non_ascii, ""))
    )


def strip_legal_suffixes(c: Column, suffixes: list[str] | None = None) -> Column:
    """Remove each suffix once, in list order, where it ends the name."""
    words = [re.sub(r"[^\w\s]", "", s.lower()).strip() for s in suffixes or V.LEGAL_SUFFIXES]
    ends_with_any = r"\b(?:" + "|".join(dict.fromkeys(words)) + ")$"
    stripped = reduce(
        lambda acc, w: F.trim(F.regexp_replace(acc, rf"\b{w}$", "")), words, c
    )
    return F.when(c.rlike(ends_with_any), stripped).otherwise(c)


def bare_name(c: Column) -> Column:
    """Folded, lower-cased, punctuation gone, single blanks; suffixes still there."""
    text = F.regexp_replace(F.lower(fold_to_ascii(c)), r"\s*&\s*", " and ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9_]+", " "))


def with_normalized_name(df: DataFrame, column: str, out: str = "normalized_name") -> DataFrame:
    """Add the comparable form of a name; empty string for a blank one.

    The folded text is read several times by the suffix rules, hence the
    projection of its own.
    """
    staged = df.withColumn("_bare", bare_name(F.col(column)))
    return staged.withColumn(
        out, F.coalesce(strip_legal_suffixes(F.col("_bare")), F.lit(""))
    ).drop("_bare")


def strip_label(c: Column, label: str) -> Column:
    """Drop a leading "Label:" and return NULL for what is then blank."""
    return blank_to_null(strip(F.regexp_replace(strip(c), rf"(?iU)^{label}[\s:]*", "")))


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double, at least one decimal, no exponent."""
    plain = F.regexp_replace(c.cast("decimal(20,7)").cast("string"), r"0+$", "")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
