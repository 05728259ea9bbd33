"""Explicit schemas of the stored tables."""

from __future__ import annotations

RAW_LISTING = """
    run_id STRING, seq BIGINT, place_id STRING, name STRING, category STRING, address STRING,
    phone STRING, website STRING, rating DOUBLE, review_count STRING, opening_hours STRING,
    profile_url STRING, latitude DOUBLE, longitude DOUBLE, status STRING, raw_payload STRING,
    scraped_at TIMESTAMP
"""

SOURCE_RECORD = """
    id STRING, run_id STRING, seq BIGINT, platform_id STRING, source_type STRING, source_url STRING,
    external_id STRING, raw_name STRING, raw_address STRING, raw_phone STRING, raw_email STRING,
    raw_website STRING, raw_category STRING, raw_latitude DOUBLE, raw_longitude DOUBLE,
    raw_rating DOUBLE, raw_review_count INT, raw_payload STRING, extraction_status STRING,
    scraped_at TIMESTAMP
"""

BUSINESS_COLUMNS = [
    "id", "run_id", "source", "source_record_id", "name", "normalized_name", "category",
    "subcategory", "address", "street", "locality", "city", "state", "postal_code", "country",
    "latitude", "longitude", "phone", "normalized_phone", "email", "website", "website_domain",
    "website_status", "rating", "review_count", "google_place_id", "google_profile_url",
    "opening_hours", "status", "created_at", "updated_at",
]

PROVENANCE_COLUMNS = [
    "id", "business_id", "run_id", "field_name", "field_value", "source_type", "source_url",
    "source_record_id", "extraction_method", "confidence", "raw_fragment", "validator_rule",
    "extracted_at",
]

PAYLOAD = """
    query STRING, city STRING, category STRING, card_lines ARRAY<STRING>,
    raw_card_html_sample STRING, extraction_strategies MAP<STRING, STRING>,
    aria_label STRING, error STRING, profile_url STRING
"""

EVIDENCE = """
    verified_at STRING, city STRING, category STRING, requested_limit INT, status STRING,
    records_discovered INT, records_saved INT, businesses_count INT, source_records_count INT,
    provenances_count INT,
    businesses ARRAY<STRUCT<
        id: STRING, run_id: STRING, source: STRING, source_record_id: STRING, name: STRING,
        normalized_name: STRING, category: STRING, subcategory: STRING, address: STRING,
        street: STRING, locality: STRING, city: STRING, state: STRING, postal_code: STRING,
        country: STRING, latitude: DOUBLE, longitude: DOUBLE, phone: STRING,
        normalized_phone: STRING, email: STRING, website: STRING, website_domain: STRING,
        website_status: STRING, rating: DOUBLE, review_count: INT, google_place_id: STRING,
        google_profile_url: STRING, opening_hours: STRING, status: STRING, created_at: STRING,
        updated_at: STRING>>,
    source_records ARRAY<STRUCT<
        id: STRING, run_id: STRING, source_type: STRING, external_id: STRING, raw_name: STRING,
        raw_address: STRING, raw_phone: STRING, raw_rating: DOUBLE, raw_review_count: INT,
        scraped_at: STRING>>
"""

PROGRESS_EVENT = """
    event STRING, run_id STRING, seq BIGINT, status STRING, stage STRING, discovered BIGINT,
    attempted BIGINT, saved BIGINT, failed BIGINT, duplicates BIGINT, percentage INT,
    at TIMESTAMP, error_message STRING
"""
