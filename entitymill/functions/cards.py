"""Text lines and links of a listing card."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import blank_to_null, first_group, fold_digits, strip, strip_label

_ANY = "(?iU)"


def card_name(lines: Column) -> Column:
    return strip(F.try_element_at(lines, F.lit(1)))


def body_lines(lines: Column) -> Column:
    """Trimmed non-empty lines below the name."""
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.filter(F.transform(rest, lambda x: strip(x)), lambda x: x != "")


def rating_line(body: Column) -> Column:
    return F.try_element_at(F.filter(body, lambda x: x.rlike(_ANY + V.CARD_RATING)), F.lit(1))


def card_rating(line: Column) -> Column:
    return fold_digits(first_group(line, _ANY + V.CARD_RATING, 1)).try_cast("double")


def card_review_count(line: Column) -> Column:
    pattern = _ANY + V.CARD_RATING
    count = F.coalesce(first_group(line, pattern, 2), first_group(line, pattern, 3))
    return F.replace(count, F.lit(","), F.lit("")).try_cast("int")


def card_hours(body: Column) -> Column:
    return F.try_element_at(F.filter(body, lambda x: x.rlike(_ANY + V.CARD_HOURS)), F.lit(-1))


def open_lines(body: Column) -> Column:
    """Lines that do not speak of opening hours; only these feed other fields."""
    return F.filter(body, lambda x: ~x.rlike(_ANY + V.CARD_HOURS))


def card_phone(lines: Column) -> Column:
    hits = F.transform(lines, lambda x: F.regexp_extract(x, "(?U)" + V.CARD_PHONE, 0))
    return strip(F.try_element_at(F.filter(hits, lambda x: x != ""), F.lit(1)))


def _parts(line: Column) -> Column:
    pieces = F.transform(F.split(line, V.CARD_SEPARATOR), lambda p: strip(p))
    return F.filter(pieces, lambda p: (p != "") & ~p.rlike(V.CARD_PRICE))


def card_category(lines: Column, default: Column) -> Column:
    heads = F.transform(
        F.filter(lines, lambda x: x.rlike(V.CARD_SEPARATOR)),
        lambda x: F.try_element_at(_parts(x), F.lit(1)),
    )
    usable = F.filter(
        heads,
        lambda h: h.isNotNull() & ~h.rlike(_ANY + V.CARD_NOT_CATEGORY) & ~h.eqNullSafe(default),
    )
    return F.coalesce(F.try_element_at(usable, F.lit(1)), default)


def card_address(lines: Column) -> Column:
    def candidate(x: Column) -> Column:
        parts = _parts(x)
        return F.when(
            x.rlike(V.CARD_SEPARATOR), F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-1)))
        ).when(x.rlike(_ANY + V.CARD_ADDRESS_CUE), x)

    return F.try_element_at(
        F.filter(F.transform(lines, candidate), lambda a: a.isNotNull()), F.lit(1)
    )


def _first_strategy(*options: tuple[Column, str]) -> Column:
    """struct(value, strategy) of the first option holding a value."""
    value = F.coalesce(*[c for c, _ in options])
    named = F.coalesce(*[F.when(c.isNotNull(), F.lit(s)) for c, s in options], F.lit("none"))
    return F.struct(value.alias("value"), named.alias("strategy"))


def phone_with_strategy(lines: Column, parsed: Column, tel_href: Column, call_label: Column) -> Column:
    def hit(x: Column) -> Column:
        mobile = F.regexp_extract(x, "(?U)" + V.TEXT_MOBILE, 0)
        landline = F.regexp_extract(x, "(?U)" + V.TEXT_LANDLINE, 0)
        return (
            F.when(mobile != "", F.struct(mobile.alias("v"), F.lit(True).alias("mobile")))
            .when(landline != "", F.struct(landline.alias("v"), F.lit(False).alias("mobile")))
        )

    first = F.try_element_at(
        F.filter(F.transform(lines, hit), lambda h: h.isNotNull()), F.lit(1)
    )
    text = strip_label(first.getField("v"), "phone")
    return _first_strategy(
        (strip_label(parsed, "phone"), "card_parsed_phone"),
        (F.when(first.getField("mobile"), text), "card_text_mobile_regex"),
        (F.when(~first.getField("mobile"), text), "card_text_landline_regex"),
        (strip_label(F.replace(tel_href, F.lit("tel:"), F.lit("")), "phone"), "card_tel_link"),
        (strip_label(call_label, "phone"), "card_call_button"),
    )


def address_with_strategy(lines: Column, parsed: Column) -> Column:
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    cues = F.transform(
        F.filter(rest, lambda x: x.rlike(_ANY + V.TEXT_ADDRESS_CUE)), lambda x: strip_label(x, "address")
    )
    cue = F.try_element_at(F.filter(cues, lambda x: x.isNotNull()), F.lit(1))
    return _first_strategy(
        (blank_to_null(parsed), "card_parsed_lines"), (cue, "card_text_address_cue")
    )


def website_with_strategy(button_href: Column, anchors: Column) -> Column:
    escaped = lambda hosts: "|".join(h.replace(".", r"\.") for h in hosts)
    button = F.when(~button_href.rlike(escaped(V.OWN_HOSTS)), blank_to_null(button_href))
    outside = F.filter(
        anchors, lambda a: a.startswith("http") & ~a.rlike(escaped(V.OWN_ANCHOR_HOSTS))
    )
    return _first_strategy(
        (button, "card_website_button"), (F.try_element_at(outside, F.lit(1)), "card_external_anchor")
    )


def metrics_with_fallback(rating: Column, reviews: Column, aria_label: Column) -> Column:
    """Card metrics, filled from the star label where the lines had none."""
    label_rating = fold_digits(first_group(aria_label, "(?U)" + V.LABEL_RATING)).try_cast("double")
    count = fold_digits(F.regexp_extract(aria_label, _ANY + V.LABEL_REVIEWS, 1))
    return F.struct(
        F.coalesce(rating, label_rating).alias("rating"),
        F.coalesce(reviews, F.replace(count, F.lit(","), F.lit("")).try_cast("int")).alias("review_count"),
    )
