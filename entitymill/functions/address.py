"""Indian postal addresses as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import blank_to_null, first_group, is_blank, literal_array, strip

_MARK = "\x01"  # stands between segments while the address is still one string


def _any_word(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def address_text(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), V.ADDRESS_LABEL, ""))


def postal_code(text: Column) -> Column:
    return first_group(text, "(?U)" + V.PIN_CODE)


def state_of(text: Column) -> Column:
    """First state in list order whose name or code occurs as a word."""
    names = [k for k, _ in V.STATES]
    hits = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + _any_word(names)), 1)
    order = literal_array(names)
    first = F.array_min(F.transform(hits, lambda h: F.array_position(order, h)))
    return F.try_element_at(literal_array([v for _, v in V.STATES]), first.cast("int"))


def city_of(text: Column, run_city: Column) -> Column:
    """The run's city when the text names it, else the longest catalog city."""
    no_pin = F.regexp_replace(text, "(?U)" + V.PIN_CODE, "")
    catalog = sorted(V.CITIES, key=lambda n: (-len(n), n))
    hits = F.regexp_extract_all(F.lower(no_pin), F.lit("(?U)" + _any_word(catalog)), 1)
    order = literal_array(catalog)
    first = F.array_min(F.transform(hits, lambda h: F.array_position(order, h)))
    named = F.try_element_at(literal_array([n.title() for n in catalog]), first.cast("int"))
    own = blank_to_null(run_city)
    # the plain containment test spares most rows a pattern of their own
    here = F.contains(F.lower(no_pin), F.lower(own)) & F.regexp_like(
        no_pin, F.concat(F.lit(r"(?iU)\b"), _quoted(own), F.lit(r"\b")))
    return F.when(F.coalesce(here, F.lit(False)), run_city).otherwise(F.coalesce(named, run_city))


def segments_of(text: Column) -> Column:
    """Non-empty segments; a numeric one joins the segment before it."""
    marked = F.regexp_replace(text, "(?U)" + V.ADDRESS_BREAK, _MARK)
    marked = F.regexp_replace(marked, rf"(?U)\s*{_MARK}[\s{_MARK}]*", _MARK)
    marked = strip(marked, _MARK)
    marked = F.regexp_replace(marked, rf"(?U){_MARK}(?=[\d\s&\-/]+(?:{_MARK}|$))", ", ")
    return F.filter(F.split(marked, _MARK), lambda p: p != "")


def _without(part: Column, name: Column, pattern: Column) -> Column:
    """``part`` less a place name: NULL if nothing but it and a PIN is left."""
    mentioned = F.coalesce(
        F.contains(F.lower(part), F.lower(name)) & F.regexp_like(part, pattern), F.lit(False))
    rest = F.regexp_replace(F.regexp_replace(part, pattern, F.lit("")), "(?U)" + V.PIN_CODE, "")
    return F.when(part.isNull() | (name.isNull()) | ~mentioned, part).otherwise(
        blank_to_null(F.btrim(rest, F.lit(" -,\n")))
    )


def content_segments(segments: Column, state: Column, city: Column) -> Column:
    """Segments that say more than PIN, country, state or city."""
    state_pattern = F.concat(F.lit("(?iU)"), _quoted(state))
    city_pattern = F.concat(F.lit(r"(?iU)\b"), _quoted(city), F.lit(r"\b"))
    tail = "(?iU)^(?:[1-9][0-9]{5}|" + "|".join(V.COUNTRY_WORDS) + ")$"

    cleaned = F.transform(
        F.filter(segments, lambda p: ~p.rlike(tail)), lambda p: _without(p, state, state_pattern)
    )
    cleaned = F.filter(cleaned, lambda p: city.isNull() | (F.lower(p) != F.lower(city)))
    cleaned = F.transform(cleaned, lambda p: _without(p, city, city_pattern))
    return F.filter(cleaned, lambda p: p.isNotNull())


def has_locality_word(c: Column) -> Column:
    return F.lower(c).rlike("|".join(V.LOCALITY_WORDS))


def _one_segment(part: Column) -> tuple[Column, Column]:
    through = "(?isU)^(.*?" + _any_word(V.THOROUGHFARE_WORDS) + ")(.*)$"
    head, rest = F.regexp_extract(part, through, 1), F.regexp_extract(part, through, 3)
    locality = F.btrim(rest, F.lit(" ,-–"))
    splits = (head != "") & (locality != "")
    premise = part.rlike(r"(?iU)\b(" + "|".join(V.PREMISE_WORDS) + r")\b")
    only_locality = (head == "") & ~premise & has_locality_word(part)
    street = F.when(splits, strip(head)).when(only_locality, F.lit(None)).otherwise(part)
    return street, F.when(splits, locality).when(only_locality, part)


def street_and_locality(parts: Column) -> tuple[Column, Column]:
    n = F.size(parts)
    one_street, one_locality = _one_segment(F.try_element_at(parts, F.lit(1)))
    tail = F.when(
        (n >= 4) & has_locality_word(F.try_element_at(parts, F.lit(-2))), F.lit(2)
    ).otherwise(F.lit(1))
    street = F.when(n == 1, one_street).when(
        n >= 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - tail, F.lit(0))), ", ")
    )
    locality = F.when(n == 1, one_locality).when(
        n >= 2, F.array_join(F.slice(parts, F.greatest(n - tail + 1, F.lit(1)), tail), ", ")
    )
    return street, locality
