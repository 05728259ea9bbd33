"""Sources, cleaning, validation and provenance over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from entitymill import vocabulary as V
from entitymill.functions.ids import stable_id
from entitymill.functions.text import ASCII_DIGITS, DIGITS, strip_label
from entitymill.functions.web import domain
from entitymill.operators import browse, cleaning, validation
from entitymill.plans import duck
from entitymill.plans.derived import _braced, table, view, with_views
from entitymill.plans.registry import query
from entitymill.sources import pages as pages_source
from entitymill.sources import raw
from entitymill.session import cut_lineage, ensure_checkpoint_dir


# --- shared steps ----------------------------------------------------------

def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return validation.clean_listings(view(spark, sf, "v_listings"))


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Valid businesses; failed extractions never reach validation."""
    reached = cleaned(spark, sf).filter("coalesce(nullif(status, ''), 'SUCCESS') <> 'EXTRACTION_FAILED'")
    return validation.canonicalize(validation.split_valid(reached)[0])


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical businesses as a stored table, the form lookups work on.

    Filters on cleaned columns would otherwise be pushed below the cleaning
    steps and repeat them once per condition.
    """
    return cut_lineage(canonical(spark, sf))


# --- web addresses ----------------------------------------------------------

@query("website_canonical_form", "CL-4 CL-5", with_views(
    duck.url_ctes("pages", "url", "page_id")[1:] + " SELECT page_id, url, domain, url_status AS status FROM urled").replace("WITH  ", "WITH "))
def website_canonical_form(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.clean_contacts(table(spark, sf, "pages").withColumn("phone", F.lit(None).cast("string")), website="url")
    return df.select("page_id", F.col("website_url").alias("url"), F.col("website_domain").alias("domain"),
                     F.col("website_status").alias("status"))


@query("pages_per_domain", "CL-4 CL-5",
       "WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages) "
       "SELECT domain, count(*) AS pages FROM h GROUP BY domain")
def pages_per_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


# --- sources ----------------------------------------------------------------

@query("raw_source_records", "IO-1 IO-8", with_views(f"""
SELECT 'src_' || sha256(run_id || '|' || CAST(seq AS STRING))[1:32] AS id, run_id, seq, 'GOOGLE' AS source_type, profile_url AS source_url,
  place_id AS external_id, name AS raw_name, address AS raw_address, phone AS raw_phone, website AS raw_website, category AS raw_category,
  latitude AS raw_latitude, longitude AS raw_longitude, round(rating, 9) AS raw_rating,
  CASE WHEN regexp_full_match(review_count, '-?\\d+') THEN CAST(review_count AS INT) END AS raw_review_count, raw_payload,
  coalesce(nullif(status, ''), 'SUCCESS') AS extraction_status FROM v_listings""", "v_listings"))
def raw_source_records(spark: SparkSession, sf: str) -> DataFrame:
    return raw.ingest_raw(view(spark, sf, "v_listings")).drop("platform_id", "raw_email", "scraped_at").withColumn(
        "raw_rating", F.round("raw_rating", 9))


@query("payload_read_back", "IO-2",
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def payload_read_back(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", raw.payload_field(F.col("props"), "$.k", "int").alias("k"))


@query("failed_extractions_kept", "IO-3", with_views(
    "SELECT seq, extract('day' FROM scraped_at) AS day, 'Unknown scraper error' AS error FROM v_listings WHERE status = 'EXTRACTION_FAILED'", "v_listings"))
def failed_extractions_kept(spark: SparkSession, sf: str) -> DataFrame:
    failed = raw.failed_extractions(raw.ingest_raw(view(spark, sf, "v_listings")))
    return failed.select("seq", F.extract(F.lit("day"), F.col("scraped_at")).cast("bigint").alias("day"), "error")


#: One JSON line per event; some are cut off, some are no JSON, some are JSON of another kind.
_JSON_LINES = """
SELECT CASE event_id % 97 WHEN 5 THEN substr(line, 1, 20) WHEN 6 THEN 'no json ' || CAST(event_id AS STRING) WHEN 7 THEN '[1, 2' WHEN 8 THEN line || '"}' ELSE line END AS line,
  event_id % 97 BETWEEN 5 AND 7 AS broken, CAST(event_id AS STRING) AS place_id, 'Café ' || CAST(user_id AS STRING) AS name
FROM (SELECT event_id, user_id, '{"place_id":"' || CAST(event_id AS STRING) || '","name":"Café ' || CAST(user_id AS STRING) || '","rating":' || CAST(event_id % 5 AS STRING) || '}' AS line FROM events) e
"""


@query("unreadable_records_kept", "IO-3", f"""
SELECT CASE WHEN broken THEN NULL ELSE place_id END AS place_id, CASE WHEN broken THEN NULL ELSE name END AS name,
  CASE WHEN broken THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN broken THEN 'unreadable record' END AS error, CASE WHEN broken THEN line END AS record
FROM ({_JSON_LINES})""")
def unreadable_records_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A file of JSON lines read back: what does not parse is a failed extraction that keeps its text."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    spark.sql(_braced(_JSON_LINES, ["events"]), events=table(spark, sf, "events")).select("line").write.text(path)
    rows = raw.read_listings(spark, path).withColumns({"run_id": F.lit("run_1"), "seq": F.lit(0).cast("bigint")})
    kept = raw.ingest_raw(rows)
    field = lambda name: raw.payload_field(F.col("raw_payload"), f"$.{name}")
    return kept.select(
        F.col("external_id").alias("place_id"), F.col("raw_name").alias("name"), F.col("extraction_status").alias("status"), field("error").alias("error"), field("record").alias("record"))


@query("schema_evolution_union", "IO-7",
       "SELECT o_orderkey AS k, o_orderpriority AS priority, CAST(0 AS INT) AS duplicates FROM orders "
       "UNION ALL SELECT l_orderkey, NULL, coalesce(l_linenumber, 0) FROM lineitem")
def schema_evolution_union(spark: SparkSession, sf: str) -> DataFrame:
    older = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"))
    newer = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("duplicates"))
    return raw.union_evolved(older, newer, {"duplicates": 0})


@query("stable_identifiers", "IO-8",
       "SELECT c_custkey, 'biz_' || sha256(CAST(c_custkey AS STRING) || '|' || c_name)[1:32] AS long_id, "
       "'biz_' || sha256(CAST(c_custkey AS STRING) || '|' || c_name)[1:12] AS short_id FROM customer")
def stable_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("c_custkey"), F.col("c_name")]
    return table(spark, sf, "customer").select(
        "c_custkey", stable_id("biz_", *keys).alias("long_id"), stable_id("biz_", *keys, digits=12).alias("short_id"))


@query("cards_from_captured_pages", "IO-9", """
WITH t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', chr(10), 'g'),
  '(?s)<[^>]*>', chr(10), 'g'), chr(10)) AS p, regexp_extract_all(html, '(?i)<a[^>]*\\shref="([^"]*)"', 1) AS a FROM pages),
l AS (SELECT page_id, a, list_filter(list_transform(p, lambda x: """ + duck.strip("x") + """), lambda x: x <> '') AS lines FROM t)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, lines[1] AS first_line, md5(array_to_string(lines, chr(10))) AS lines_hash,
  CAST(len(a) AS BIGINT) AS n_anchors, md5(array_to_string(a, chr(10))) AS anchors_hash,
  CAST(len(list_filter(a, lambda x: contains(x, '/maps/place/'))) AS BIGINT) AS n_listing_links FROM l""")
def cards_from_captured_pages(spark: SparkSession, sf: str) -> DataFrame:
    cards = pages_source.cards_from_pages(table(spark, sf, "pages"))
    size = lambda c: F.size(c).cast("bigint")
    return cards.select(
        "page_id", size("lines").alias("n_lines"), F.try_element_at("lines", F.lit(1)).alias("first_line"),
        F.md5(F.array_join("lines", "\n")).alias("lines_hash"), size("anchors").alias("n_anchors"),
        F.md5(F.array_join("anchors", "\n")).alias("anchors_hash"), size("listing_links").alias("n_listing_links"))


# --- identity, contacts, metrics ------------------------------------------------

@query("name_canonical_form", "CL-1 CL-2", with_views(
    f"SELECT seq, nullif({duck.strip('name')}, '') AS clean_name, {duck.name('name')} AS normalized_name FROM v_listings", "v_listings"))
def name_canonical_form(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_identity(view(spark, sf, "v_listings")).select("seq", "clean_name", "normalized_name")


@query("document_text_canonical_form", "CL-1 CL-2", f"SELECT doc_id, md5({duck.name('text')}) AS normalized FROM documents")
def document_text_canonical_form(spark: SparkSession, sf: str) -> DataFrame:
    """The name rules over whole texts in four languages: accents, punctuation, suffixes."""
    df = cleaning.clean_identity(table(spark, sf, "documents"), "text")
    return df.select("doc_id", F.md5("normalized_name").alias("normalized"))


@query("phone_canonical_form", "CL-3", with_views(
    "\x00", "v_listings").replace(" \x00", ", " + duck.phone_ctes("v_listings", "phone", "seq") +
                                  " SELECT seq, e164, phone_status FROM phoned"))
def phone_canonical_form(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.clean_contacts(view(spark, sf, "v_listings"))
    return df.select("seq", F.col("normalized_phone").alias("e164"), "phone_status")


@query("website_of_listing", "CL-4 CL-5 CL-6", with_views(
    "\x00", "v_listings").replace(" \x00", ", " + duck.url_ctes("v_listings", "website", "seq, website") +
                                  " SELECT seq, coalesce(url, website) AS website, domain, url_status FROM urled"))
def website_of_listing(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.clean_contacts(view(spark, sf, "v_listings"))
    return df.select("seq", F.col("website_url").alias("website"), F.col("website_domain").alias("domain"),
                     F.col("website_status").alias("url_status"))


_LAT, _LON = duck.coordinates("latitude", "longitude")


@query("valid_coordinates", "CL-7", with_views(f"SELECT seq, {_LAT} AS latitude, {_LON} AS longitude FROM v_listings", "v_listings"))
def valid_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_coordinates(view(spark, sf, "v_listings")).select("seq", "latitude", "longitude")


@query("valid_ratings_and_reviews", "CL-8 CL-9", with_views("""
SELECT seq, CASE WHEN rating BETWEEN 0 AND 5 THEN round(rating, 2) END AS rating,
  CASE WHEN regexp_full_match(review_count, '-?\\d+') AND CAST(review_count AS INT) >= 0 THEN CAST(review_count AS INT) END AS review_count
FROM v_listings""", "v_listings"))
def valid_ratings_and_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_metrics(view(spark, sf, "v_listings")).select("seq", "rating", "review_count")


@query("label_prefixes_stripped", "CL-10", with_views(
    f"SELECT seq, {duck.label('phone', 'phone')} AS phone, {duck.label('address', 'address')} AS address FROM v_listings", "v_listings"))
def label_prefixes_stripped(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_listings").select(
        "seq", strip_label(F.col("phone"), "phone").alias("phone"), strip_label(F.col("address"), "address").alias("address"))


@query("place_ids_and_coordinates_from_links", "CL-11 CL-12", with_views("""
SELECT page_id, coalesce(nullif(regexp_extract(link, '19s(ChIJ[\\w-]+)', 1), ''), nullif(regexp_extract(link, '[?&]place_id=([a-zA-Z0-9_-]+)', 1), ''),
    nullif(regexp_extract(link, '[?&]ftid=([0-9a-zA-Z_:-]+)', 1), ''), nullif(regexp_extract(link, '1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1), ''),
    'slug_' || nullif(regexp_extract(link, '/maps/place/([^/@?]+)', 1)[1:40], '')) AS place_id,
  CASE WHEN regexp_matches(link, '!3d-?\\d+\\.\\d+!4d-?\\d+\\.\\d+') THEN CAST(regexp_extract(link, '!3d(-?\\d+\\.\\d+)!4d', 1) AS DOUBLE)
    ELSE CAST(nullif(regexp_extract(link, '@(-?\\d+\\.\\d+),-?\\d+\\.\\d+', 1), '') AS DOUBLE) END AS latitude,
  CASE WHEN regexp_matches(link, '!3d-?\\d+\\.\\d+!4d-?\\d+\\.\\d+') THEN CAST(regexp_extract(link, '!4d(-?\\d+\\.\\d+)', 1) AS DOUBLE)
    ELSE CAST(nullif(regexp_extract(link, '@-?\\d+\\.\\d+,(-?\\d+\\.\\d+)', 1), '') AS DOUBLE) END AS longitude
FROM (SELECT page_id, translate(link, '""" + DIGITS + "', '" + ASCII_DIGITS + """') AS link FROM v_links)""", "v_links"))
def place_ids_and_coordinates_from_links(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.read_links(view(spark, sf, "v_links"), "link").drop("link")


# --- cards ------------------------------------------------------------------------

def cards(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    df = view(spark, sf, "v_cards").withColumn("lines", lines)
    return cleaning.parse_cards(df, "lines", F.lit("Salon"))


def _folded(x: str) -> str:
    """Digits of all scripts as ASCII digits: here \\d and \\b know ASCII only."""
    return f"translate({x}, '{DIGITS}', '{ASCII_DIGITS}')"


def _picked(x: str, pattern: str) -> str:
    """The first match as it is written."""
    hit = f"regexp_extract({_folded(x)}, '{pattern}')"
    return f"substr({x}, strpos({_folded(x)}, {hit}), len({hit}))"


def _words(pattern: str) -> str:
    """Word borders that know letters beyond ASCII, without look-around."""
    return "(?i)(?:^|[^\\pL\\pM\\pN_])" + pattern.removeprefix("\\b").removesuffix("\\b") + "(?:[^\\pL\\pM\\pN_]|$)"


_CUE = _words(V.CARD_ADDRESS_CUE)
_CARD_CTES = f"""
c1 AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {duck.strip('x')}), lambda x: x <> '') AS lines FROM v_cards),
c2 AS (SELECT *, lines[2:] AS b, list_filter(lines[2:], lambda x: NOT regexp_matches(x, '(?i){V.CARD_HOURS}')) AS o,
  list_filter(lines[2:], lambda x: regexp_matches({_folded('x')}, '(?i){V.CARD_RATING}'))[1] AS r FROM c1),
c3 AS (SELECT *, list_transform(o, lambda x: {{'sep': regexp_matches(x, '{V.CARD_SEPARATOR}'), 'line': x,
  'p': list_filter(list_transform(string_split_regex(x, '{V.CARD_SEPARATOR}'), lambda y: {duck.strip('y')}), lambda y: y <> '' AND NOT regexp_matches(y, '{V.CARD_PRICE}'))}}) AS s FROM c2),
card AS (SELECT *, lines[1] AS name, CAST(nullif(regexp_extract({_folded('r')}, '(?i){V.CARD_RATING}', 1), '') AS DOUBLE) AS rating,
  CAST(nullif(replace(coalesce(nullif(regexp_extract({_folded('r')}, '(?i){V.CARD_RATING}', 2), ''), regexp_extract({_folded('r')}, '(?i){V.CARD_RATING}', 3)), ',', ''), '') AS INT) AS review_count,
  list_filter(b, lambda x: regexp_matches(x, '(?i){V.CARD_HOURS}'))[-1] AS opening_hours,
  list_filter(list_transform(o, lambda x: {_picked('x', V.CARD_PHONE)}), lambda x: x <> '')[1] AS phone,
  coalesce(list_filter(s, lambda z: z.sep AND len(z.p) > 0 AND NOT regexp_matches({_folded('z.p[1]')}, '(?i){V.CARD_NOT_CATEGORY}') AND z.p[1] <> 'Salon')[1].p[1], 'Salon') AS category,
  list_filter(list_transform(s, lambda z: CASE WHEN z.sep THEN CASE WHEN len(z.p) >= 2 THEN z.p[-1] END
    WHEN regexp_matches(z.line, '{_CUE}') THEN z.line END), lambda x: x IS NOT NULL)[1] AS address FROM c3)"""


def _card_sql(tail: str) -> str:
    return with_views("\x00", "v_cards").replace(" \x00", ", " + _CARD_CTES + " " + tail)


@query("card_lines_parsed", "CL-13 CL-14 CL-15 CL-16 CL-17 CL-18", _card_sql(
    "SELECT conv_id, turn, name, rating, review_count, opening_hours, phone, category, address FROM card"))
def card_lines_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return cards(spark, sf).select(
        "conv_id", "turn", "name", "rating", "review_count", "opening_hours", "phone", "category", "address")


@query("contact_strategies", "CL-19", _card_sql(f"""
, pick AS (SELECT *, list_filter(list_transform(lines, lambda x: CASE WHEN regexp_matches({_folded('x')}, '{V.TEXT_MOBILE}') THEN 'm' || {_picked('x', V.TEXT_MOBILE)}
    WHEN regexp_matches({_folded('x')}, '{V.TEXT_LANDLINE}') THEN 'l' || {_picked('x', V.TEXT_LANDLINE)} END), lambda x: x IS NOT NULL)[1] AS hit,
  list_filter(lines[2:], lambda x: regexp_matches(x, '{_words(V.TEXT_ADDRESS_CUE)}'))[1] AS cue,
  regexp_extract_all(body, 'https?://[^\\s"]+') AS links FROM card)
SELECT conv_id, turn, coalesce({duck.label('phone', 'phone')}, hit[2:], {duck.label("replace(tel_href, 'tel:', '')", 'phone')}, {duck.label('call_label', 'phone')}) AS phone,
  CASE WHEN phone IS NOT NULL THEN 'card_parsed_phone' WHEN hit[1] = 'm' THEN 'card_text_mobile_regex' WHEN hit[1] = 'l' THEN 'card_text_landline_regex'
    WHEN tel_href IS NOT NULL THEN 'card_tel_link' WHEN call_label IS NOT NULL THEN 'card_call_button' ELSE 'none' END AS phone_strategy,
  coalesce(address, cue) AS address, CASE WHEN address IS NOT NULL THEN 'card_parsed_lines' WHEN cue IS NOT NULL THEN 'card_text_address_cue' ELSE 'none' END AS address_strategy,
  coalesce(CASE WHEN website_href NOT LIKE '%google.com%' THEN website_href END, links[1]) AS website,
  CASE WHEN website_href NOT LIKE '%google.com%' THEN 'card_website_button' WHEN len(links) > 0 THEN 'card_external_anchor' ELSE 'none' END AS website_strategy,
  coalesce(rating, CAST(nullif(regexp_extract({_folded('aria_label')}, '(\\d+\\.\\d+)', 1), '') AS DOUBLE)) AS rating,
  coalesce(review_count, CAST(nullif(replace(regexp_extract({_folded('aria_label')}, '(?i)([\\d,]+)\\s+reviews?', 1), ',', ''), '') AS INT)) AS review_count FROM pick"""))
def contact_strategies(spark: SparkSession, sf: str) -> DataFrame:
    df = cards(spark, sf).withColumn("anchors", F.regexp_extract_all("body", F.lit(r'https?://[^\s"]+'), 0))
    return cleaning.extract_contacts(df).select(
        "conv_id", "turn", "phone", "phone_strategy", "address", "address_strategy", "website", "website_strategy",
        "rating", "review_count")


@query("contacts_in_documents", "CL-20", f"""
WITH h AS (SELECT doc_id, 'mobile' AS kind, unnest(regexp_extract_all(text, '{V.TEXT_MOBILE}')) AS value FROM documents
UNION ALL SELECT doc_id, 'landline', unnest(regexp_extract_all(text, '{V.TEXT_LANDLINE}')) FROM documents
UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '{V.TEXT_EMAIL}')) FROM documents)
SELECT DISTINCT doc_id, kind, value FROM h""")
def contacts_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.mine_contacts(table(spark, sf, "documents")).select("doc_id", "kind", "value")


# --- addresses ----------------------------------------------------------------------

@query("address_parts", "AD-1 AD-2 AD-3 AD-4 AD-5 AD-6 AD-7 AD-8 AD-9 AD-10 AD-11", with_views(
    "\x00", "v_listings").replace(" \x00", ", " + duck.address_ctes("v_listings", "address", "run_city", "seq") + " SELECT * FROM addressed"))
def address_parts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.parse_address(view(spark, sf, "v_listings"), "address", "run_city").select(
        "seq", "street", "locality", "city", "state", "postal_code", "country")


@query("address_parts_without_run_city", "AD-1 AD-5 AD-8", with_views(
    "\x00", "v_listings").replace(" \x00", ", " + duck.address_ctes("v_listings", "address", "CAST(NULL AS STRING)", "seq") + " SELECT * FROM addressed"))
def address_parts_without_run_city(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.parse_address(view(spark, sf, "v_listings"), "address").select(
        "seq", "street", "locality", "city", "state", "postal_code", "country")


# --- validation and provenance --------------------------------------------------------

@query("name_gate", "V-1", duck.listings("SELECT seq, error FROM checked WHERE error IS NOT NULL"))
def name_gate(spark: SparkSession, sf: str) -> DataFrame:
    rejected = validation.split_valid(cleaned(spark, sf))[1]
    return rejected.select("seq", F.element_at("errors", 1).alias("error"))


@query("canonical_businesses", "V-2 V-3 V-4", duck.listings("""
SELECT 'biz_' || sha256(run_id || '|' || CAST(seq AS STRING))[1:32] AS id, run_id, seq, name, normalized_name, category, address, street, locality, city,
  state, postal_code, country, latitude, longitude, phone, normalized_phone, website, website_domain, website_status, rating, review_count,
  google_place_id, google_profile_url, opening_hours, 'VALID' AS status FROM biz"""))
def canonical_businesses(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(spark, sf).drop(
        "raw_website", "source", "source_record_id", "subcategory", "email", "created_at", "updated_at")


@query("field_states", "V-4", duck.listings("""
SELECT phone_status, website_status, count(*) AS n FROM (SELECT phone_status, url_status AS website_status FROM checked WHERE error IS NULL) GROUP BY 1, 2"""))
def field_states(spark: SparkSession, sf: str) -> DataFrame:
    accepted = validation.split_valid(cleaned(spark, sf))[0]
    return accepted.groupBy("phone_status", "website_status").agg(F.count(F.lit(1)).alias("n"))


def _provenance_sql() -> str:
    fragment = {"street": "address", "locality": "address", "postal_code": "address", "state": "address", "normalized_name": "name",
                "normalized_phone": "phone", "website": "raw_website", "website_domain": "raw_website",
                "google_place_id": "NULL", "coordinates": "NULL", "rating": "NULL", "review_count": "NULL"}
    number = lambda c: f"regexp_replace(CAST(CAST({c} AS DECIMAL(20,7)) AS STRING), '(\\.\\d+?)0+$', '\\1')"
    value = {"coordinates": f"{number('latitude')} || ',' || {number('longitude')}", "rating": number("rating"),
             "review_count": "CAST(review_count AS STRING)"}
    parts = [
        f"SELECT run_id, seq, '{f}' AS field_name, {value.get(f, f)} AS field_value, '{m}' AS extraction_method, CAST({c} AS DOUBLE) AS confidence, "
        f"'{r}' AS validator_rule, coalesce(nullif({fragment.get(f, f)}, ''), ({value.get(f, f)})[1:200]) AS raw_fragment FROM biz"
        for f, m, c, r in V.PROVENANCE
    ]
    return duck.listings("SELECT * FROM prov WHERE field_value <> ''", "prov AS (" + " UNION ALL ".join(parts) + ")")


@query("field_provenance", "V-5", _provenance_sql())
def field_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return validation.provenance(canonical(spark, sf), carry=("seq",)).select(
        "run_id", "seq", "field_name", "field_value", "extraction_method", "confidence", "validator_rule", "raw_fragment")


@query("provenance_per_field", "V-5", _provenance_sql().replace(
    "SELECT * FROM prov WHERE field_value <> ''",
    "SELECT field_name, extraction_method, validator_rule, count(*) AS n, round(avg(confidence), 4) AS confidence FROM prov WHERE field_value <> '' GROUP BY 1, 2, 3"))
def provenance_per_field(spark: SparkSession, sf: str) -> DataFrame:
    return validation.provenance(canonical(spark, sf)).groupBy("field_name", "extraction_method", "validator_rule").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("orphaned_rows", "V-6", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""")
def orphaned_rows(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "supplier").filter("s_acctbal >= 0")
    return validation.orphans(table(spark, sf, "lineitem"), parents, "l_suppkey", "s_suppkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey")


@query("reject_reasons", "V-7", duck.listings("SELECT error, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY 1"))
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return validation.reject_counts(validation.split_valid(cleaned(spark, sf))[1])


@query("run_requests_checked", "V-8", with_views("""
SELECT request_id, trim(city) AS city_input, lower(trim(city)) AS city_normalized, trim(category) AS clean_category,
  array_to_string(list_filter([CASE WHEN trim(city) = '' THEN 'City must not be empty.' END, CASE WHEN trim(category) = '' THEN 'Category must not be empty.' END,
    CASE WHEN requested_limit <= 0 THEN 'Limit must be greater than 0.' END, CASE WHEN requested_limit > 1000 THEN 'Limit must be less than or equal to 1000.' END,
    CASE WHEN confidence_threshold < 0 OR confidence_threshold > 1 THEN 'Confidence threshold must be between 0.0 and 1.0.' END], lambda e: e IS NOT NULL), ' ') AS errors
FROM v_requests""", "v_requests"))
def run_requests_checked(spark: SparkSession, sf: str) -> DataFrame:
    checked = validation.validate_requests(view(spark, sf, "v_requests"))
    return checked.select("request_id", "city_input", "city_normalized", "clean_category", F.array_join("errors", " ").alias("errors"))


@query("values_outside_domain", "V-9", with_views(
    "SELECT status AS value, count(*) AS n FROM v_status_log WHERE status NOT IN ('CREATED', 'QUEUED', 'RUNNING', 'INTERRUPTED', 'COMPLETED', "
    "'PARTIAL', 'FAILED', 'CANCELLED') GROUP BY 1", "v_status_log"))
def values_outside_domain(spark: SparkSession, sf: str) -> DataFrame:
    return validation.domain_violations(view(spark, sf, "v_status_log"), "status", V.RUN_STATUSES)


@query("snapshot_fidelity", "V-10", duck.listings("""
SELECT count(*) AS businesses, count(*) FILTER (name IS NULL OR name = '') AS without_name, count(*) FILTER (city IS DISTINCT FROM 'Mumbai') AS other_city,
  count(*) FILTER (NOT starts_with(coalesce(google_place_id, ''), 'ChIJ')) AS other_place_id,
  count(google_place_id) - count(DISTINCT google_place_id) AS repeated_place_id FROM biz"""))
def snapshot_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    return validation.snapshot_report(canonical(spark, sf), "Mumbai")


@query("displayed_businesses", "Q-16", duck.listings("""
SELECT seq, name, coalesce(nullif(category, ''), 'General') AS category, coalesce(nullif(address, ''), '—') AS address, coalesce(nullif(city, ''), 'Unknown city') AS city,
  coalesce(normalized_phone, nullif(phone, ''), 'Missing') AS phone, CASE WHEN website_domain IS NOT NULL THEN coalesce(nullif(website, ''), 'https://' || website_domain) END AS link,
  coalesce(website_domain, 'Missing') AS website FROM biz"""))
def displayed_businesses(spark: SparkSession, sf: str) -> DataFrame:
    return browse.display(canonical(spark, sf), carry=("seq",)).drop("id")
