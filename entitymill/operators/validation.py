"""From raw listings to canonical businesses, rejects and field provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions.ids import stable_id
from entitymill.functions.text import blank_to_null, is_blank, number_text, strip
from entitymill.operators import cleaning
from entitymill.schemas import BUSINESS_COLUMNS, PROVENANCE_COLUMNS


def clean_listings(listings: DataFrame, run_city: str = "run_city") -> DataFrame:
    """All cleaning jobs over raw listings, plus an ``errors`` array.

    The name gate is the only reason to reject a row; every other field that
    does not validate becomes NULL and the row is kept.
    """
    df = listings.withColumns({"raw_phone": F.col("phone"), "raw_website": F.col("website")})
    df = cleaning.clean_identity(df)
    df = cleaning.clean_contacts(df)
    df = cleaning.clean_metrics(df)
    df = cleaning.clean_coordinates(df)
    df = cleaning.parse_address(df, "address", run_city)
    return df.withColumn("errors", name_errors(F.col("name"), F.col("normalized_name")))


def name_errors(name: Column, normalized: Column) -> Column:
    found = F.array(
        F.when(is_blank(name), F.lit(V.NAME_MISSING)),
        F.when(~is_blank(name) & (normalized == ""), F.lit(V.NAME_EMPTY)),
    )
    return F.filter(found, lambda e: e.isNotNull())


def split_valid(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the name gate."""
    return cleaned.filter(F.size("errors") == 0), cleaned.filter(F.size("errors") > 0)


def reject_counts(rejected: DataFrame) -> DataFrame:
    return rejected.select(F.explode("errors").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n")
    )


def canonicalize(accepted: DataFrame) -> DataFrame:
    """The 31 stored columns, plus ``seq`` which orders records within a run."""
    columns = {
        "id": stable_id("biz_", F.col("run_id"), F.col("seq")),
        "source": F.lit("GOOGLE"),
        "source_record_id": stable_id("src_", F.col("run_id"), F.col("seq")),
        "name": F.col("clean_name"),
        "subcategory": F.lit(None).cast("string"),
        "phone": F.col("raw_phone"),
        "email": F.lit(None).cast("string"),
        "website": F.col("website_url"),
        "google_place_id": F.col("place_id"),
        "google_profile_url": F.col("profile_url"),
        "status": F.lit("VALID"),
        "created_at": F.col("scraped_at"),
        "updated_at": F.col("scraped_at"),
    }
    return accepted.select(
        "seq", "raw_website",
        *[columns[c].alias(c) if c in columns else F.col(c) for c in BUSINESS_COLUMNS],
    )


def trail() -> Column:
    """What is known of a business's non-empty fields, as an array in its own row."""
    cut = lambda c: F.substring(c, 1, 200)
    c = F.col
    coordinates = F.concat(number_text(c("latitude")), F.lit(","), number_text(c("longitude")))
    rating, reviews = number_text(c("rating")), c("review_count").cast("string")
    # (value, fragment) per field; a blank fragment falls back to the value itself
    values = {
        "google_place_id": (c("google_place_id"), None),
        "name": (c("name"), c("name")),
        "normalized_name": (c("normalized_name"), c("name")),
        "category": (c("category"), c("category")),
        "address": (c("address"), c("address")),
        "street": (c("street"), c("address")),
        "locality": (c("locality"), c("address")),
        "postal_code": (c("postal_code"), c("address")),
        "state": (c("state"), c("address")),
        "phone": (c("phone"), c("phone")),
        "normalized_phone": (c("normalized_phone"), c("phone")),
        "website": (c("website"), c("raw_website")),
        "website_domain": (c("website_domain"), c("raw_website")),
        "coordinates": (coordinates, None),
        "rating": (rating, None),
        "review_count": (reviews, None),
    }
    entries = []
    for field, method, confidence, rule in V.PROVENANCE:
        value, fragment = values[field]
        fallback = cut(value)
        entries.append(F.struct(
            F.lit(field).alias("field_name"),
            value.alias("field_value"),
            F.lit(method).alias("extraction_method"),
            F.lit(confidence).alias("confidence"),
            (fallback if fragment is None else F.coalesce(blank_to_null(fragment), fallback)).alias("raw_fragment"),
            F.lit(rule).alias("validator_rule"),
        ))
    return F.filter(F.array(*entries), lambda e: e.getField("field_value") != "")


def provenance(businesses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per business and non-empty field, from one pass over the table; columns in ``carry`` come along."""
    c = F.col
    rows = businesses.select(
        *carry, c("id").alias("business_id"), "run_id", c("source").alias("source_type"),
        c("google_profile_url").alias("source_url"), "source_record_id",
        c("created_at").alias("extracted_at"), F.explode(trail()).alias("p"),
    ).select("*", "p.*")
    return rows.withColumn(
        "id", stable_id("prov_", c("business_id"), c("field_name"))
    ).select(*PROVENANCE_COLUMNS, *carry)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Child rows that name a parent which does not exist."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Run definitions with their errors; trimmed and lower-cased city added."""
    empty_city, empty_category, low, high, threshold = V.REQUEST_ERRORS
    checks = F.array(
        F.when(is_blank(F.col("city")), F.lit(empty_city)),
        F.when(is_blank(F.col("category")), F.lit(empty_category)),
        F.when(F.col("requested_limit") <= 0, F.lit(low)),
        F.when(F.col("requested_limit") > V.MAX_REQUESTED_LIMIT, F.lit(high)),
        F.when(
            (F.col("confidence_threshold") < 0.0) | (F.col("confidence_threshold") > 1.0),
            F.lit(threshold),
        ),
    )
    return requests.withColumns({
        "city_input": strip(F.col("city")),
        "city_normalized": F.lower(strip(F.col("city"))),
        "clean_category": strip(F.col("category")),
        "errors": F.filter(checks, lambda e: e.isNotNull()),
    })


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of an enumeration column outside its domain, with their counts."""
    return df.filter(~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def snapshot_report(businesses: DataFrame, city: str, place_prefix: str = "ChIJ") -> DataFrame:
    """Fidelity counts of a stored snapshot, one row."""
    return businesses.agg(
        F.count(F.lit(1)).alias("businesses"),
        F.count_if(F.col("name").isNull() | (strip(F.col("name")) == "")).alias("without_name"),
        F.count_if(~F.col("city").eqNullSafe(F.lit(city))).alias("other_city"),
        F.count_if(~F.coalesce(F.col("google_place_id").startswith(place_prefix), F.lit(False))).alias("other_place_id"),
        (F.count("google_place_id") - F.count_distinct("google_place_id")).alias("repeated_place_id"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
