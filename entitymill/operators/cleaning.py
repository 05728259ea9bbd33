"""Cleaning jobs: each adds columns, none shuffles, all run on streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions import address as A
from entitymill.functions import cards as C
from entitymill.functions.geo import (
    clean_rating, clean_reviews, coordinates_from_url, place_id_from_url, validate_coordinates,
)
from entitymill.functions.phone import with_phone
from entitymill.functions.text import (
    blank_to_null, is_blank, strip, strip_label, with_normalized_name,
)
from entitymill.functions.web import normalize_email, with_url


def clean_identity(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``clean_name`` and ``normalized_name``."""
    return with_normalized_name(df, name).withColumn("clean_name", blank_to_null(strip(F.col(name))))


def clean_contacts(df: DataFrame, phone: str = "phone", website: str = "website") -> DataFrame:
    """Add normalized phone, canonical website and their field states."""
    df = with_url(with_phone(df, phone), website)
    return df.withColumn("website_url", F.coalesce(F.col("website_url"), F.col(website)))


def clean_metrics(df: DataFrame) -> DataFrame:
    """Replace rating and review count by their valid values or NULL."""
    return df.withColumns({
        "rating": clean_rating(F.col("rating")),
        "review_count": clean_reviews(F.col("review_count")),
    })


def clean_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    staged = df.withColumn("_point", validate_coordinates(F.col(lat), F.col(lon)))
    return staged.withColumns(
        {lat: F.col("_point.latitude"), lon: F.col("_point.longitude")}
    ).drop("_point")


def read_links(df: DataFrame, url: str) -> DataFrame:
    """Add place id and coordinates carried by a listing link."""
    staged = df.withColumns({
        "place_id": place_id_from_url(F.col(url)), "_point": coordinates_from_url(F.col(url)),
    })
    return staged.withColumns(
        {"latitude": F.col("_point.latitude"), "longitude": F.col("_point.longitude")}
    ).drop("_point")


def parse_address(df: DataFrame, address: str = "address", run_city: str | Column | None = None) -> DataFrame:
    """Add street, locality, city, state, postal_code and country.

    Intermediate results get their own projection so that each regular
    expression runs once per row instead of once per use.
    """
    own_city = F.lit(None).cast("string") if run_city is None else (
        F.col(run_city) if isinstance(run_city, str) else run_city
    )
    given = ~is_blank(F.col(address))
    staged = df.withColumns({
        "_city0": own_city,
        "_text": F.when(given, A.address_text(F.col(address))),
    })
    staged = staged.withColumns({
        "_state": A.state_of(F.col("_text")),
        "_city": F.when(F.col("_text").isNull(), F.col("_city0")).otherwise(
            A.city_of(F.col("_text"), F.col("_city0"))
        ),
    })
    staged = staged.withColumn(
        "_parts", A.content_segments(A.segments_of(F.col("_text")), F.col("_state"), F.col("_city"))
    )
    last = F.try_element_at(F.col("_parts"), F.lit(-1))
    takes_last = (
        blank_to_null(F.col("_city")).isNull() & last.isNotNull()
        & ~F.lower(last).rlike("|".join(V.NOT_A_CITY_WORDS))
    )
    staged = staged.withColumns({
        "_city": F.when(takes_last, last).otherwise(F.col("_city")),
        "_parts": F.when(
            takes_last, F.slice(F.col("_parts"), F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(0)))
        ).otherwise(F.col("_parts")),
    })
    street, locality = A.street_and_locality(F.col("_parts"))
    return staged.withColumns({
        "street": street,
        "locality": locality,
        "city": F.coalesce(blank_to_null(F.col("_city")), F.col("_city0")),
        "state": F.col("_state"),
        "postal_code": A.postal_code(F.col("_text")),
        "country": F.lit(V.COUNTRY_NAME),
    }).drop("_text", "_state", "_city", "_city0", "_parts")


def parse_cards(df: DataFrame, lines: str = "lines", default_category: str | Column | None = None) -> DataFrame:
    """Add the fields a listing card's text lines hold."""
    default = F.lit(None).cast("string") if default_category is None else (
        F.col(default_category) if isinstance(default_category, str) else default_category
    )
    staged = df.withColumns({"_body": C.body_lines(F.col(lines)), "_default": default})
    staged = staged.withColumns({
        "_open": C.open_lines(F.col("_body")), "_rated": C.rating_line(F.col("_body")),
    })
    return staged.withColumns({
        "name": C.card_name(F.col(lines)),
        "rating": C.card_rating(F.col("_rated")),
        "review_count": C.card_review_count(F.col("_rated")),
        "opening_hours": C.card_hours(F.col("_body")),
        "phone": C.card_phone(F.col("_open")),
        "category": C.card_category(F.col("_open"), F.col("_default")),
        "address": C.card_address(F.col("_open")),
    }).drop("_body", "_open", "_rated", "_default")


def extract_contacts(cards: DataFrame) -> DataFrame:
    """Contact fields by the first strategy that yields one, with its name.

    Expects ``parse_cards`` output plus tel_href, call_label, website_href,
    anchors and aria_label; missing inputs are NULL columns.
    """
    lines = F.col("lines")
    staged = cards.withColumns({
        "_phone": C.phone_with_strategy(lines, F.col("phone"), F.col("tel_href"), F.col("call_label")),
        "_address": C.address_with_strategy(lines, F.col("address")),
        "_website": C.website_with_strategy(F.col("website_href"), F.col("anchors")),
        "_metrics": C.metrics_with_fallback(F.col("rating"), F.col("review_count"), F.col("aria_label")),
    })
    return staged.withColumns({
        "phone": F.col("_phone.value"), "phone_strategy": F.col("_phone.strategy"),
        "address": F.col("_address.value"), "address_strategy": F.col("_address.strategy"),
        "website": F.col("_website.value"), "website_strategy": F.col("_website.strategy"),
        "rating": F.col("_metrics.rating"), "review_count": F.col("_metrics.review_count"),
    }).drop("_phone", "_address", "_website", "_metrics")


def mine_contacts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per phone number or e-mail address found in a text, whole text read."""
    found = F.array_union(
        F.transform(
            F.regexp_extract_all(F.col(text), F.lit(f"(?U)({V.TEXT_MOBILE})"), 1),
            lambda v: F.struct(F.lit("mobile").alias("kind"), v.alias("value")),
        ),
        F.array_union(
            F.transform(
                F.regexp_extract_all(F.col(text), F.lit(f"(?U)({V.TEXT_LANDLINE})"), 1),
                lambda v: F.struct(F.lit("landline").alias("kind"), v.alias("value")),
            ),
            F.transform(
                F.regexp_extract_all(F.col(text), F.lit(f"({V.TEXT_EMAIL})"), 1),
                lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value")),
            ),
        ),
    )
    return docs.withColumn("_hit", F.explode(found)).withColumns({"kind": F.col("_hit.kind"), "value": F.col("_hit.value")}).drop("_hit", text)


def clean_emails(df: DataFrame, email: str = "email") -> DataFrame:
    staged = df.withColumn("_email", normalize_email(F.col(email)))
    return staged.withColumns({
        "normalized_email": F.col("_email.normalized_email"),
        "is_verified_format": F.col("_email.is_verified_format"),
    }).drop("_email")


__all__ = [
    "clean_identity", "clean_contacts", "clean_metrics", "clean_coordinates", "read_links",
    "parse_address", "parse_cards", "extract_contacts", "mine_contacts", "clean_emails", "strip_label",
]
