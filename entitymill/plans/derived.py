"""Listing-shaped tables derived from the test tables.

The SQL below is plain enough to mean the same in Spark and in DuckDB, so both
sides of a check start from equal rows. Every source row yields a row: values
vary with the keys to cover blank, broken and repeated input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from entitymill.operators.scale import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_CITY = """CASE {k} % 5 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Navi Mumbai'
  WHEN 3 THEN 'Bengaluru' ELSE 'Noida' END"""
_STATE = """CASE {k} % 5 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Maharashtra' WHEN 2 THEN 'MH'
  WHEN 3 THEN 'Karnataka' ELSE 'Uttar Pradesh' END"""


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_U = _s("user_id")
_PIN = _s("400001 + user_id % 97")

_LISTINGS = f"""
SELECT 'run_' || {_s('CAST(ts AS DATE)')} AS run_id, event_id AS seq,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
       ELSE 'ChIJ' || {_U} || '_' || {_s('event_id % 3')} END AS place_id,
  CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN ' ## ' WHEN event_id % 47 = 0 THEN NULL
       ELSE c_name || CASE event_id % 7 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' & Sons' WHEN 2 THEN ' LLP'
         WHEN 3 THEN ' Café' WHEN 4 THEN ' Private Limited' WHEN 5 THEN '''s Co.' ELSE '  ' END END AS name,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE c_mktsegment END AS category,
  CASE event_id % 9
    WHEN 0 THEN NULL
    WHEN 1 THEN 'Shop No. 3, 4, 5, ' || c_mktsegment || ' Building, ' || {_U} || ' Feet Rd, Deendayal Nagar, Mulund East, '
      || {_CITY.format(k='user_id')} || ', ' || {_STATE.format(k='user_id')} || ' ' || {_PIN}
    WHEN 2 THEN 'Address: ' || {_U} || ' MG Road Bandra West'
    WHEN 3 THEN 'Plot ' || {_U} || ' | Sector 9 - ' || {_CITY.format(k='user_id')} || '; ' || {_STATE.format(k='user_id')} || ' ' || {_PIN}
    WHEN 4 THEN 'Deendayal Nagar'
    WHEN 5 THEN ' Near Station ' || {_U} || ' , ' || {_CITY.format(k='event_id')} || ' ' || {_PIN} || ', India '
    WHEN 6 THEN c_mktsegment || ' House, Lane ' || {_U} || chr(10) || 'Old Market, ' || {_CITY.format(k='user_id')}
    WHEN 7 THEN 'Flat ' || {_U} || ' High Street'
    ELSE 'Unit ' || {_U} || ', Tower B, Tech Park, East Wing, Bharat' END AS address,
  CASE event_id % 8
    WHEN 0 THEN '+91 98200 ' || lpad({_U}, 5, '0') WHEN 1 THEN '098200' || lpad({_U}, 5, '0')
    WHEN 2 THEN 'Phone: 98200 ' || lpad({_U}, 5, '0') WHEN 3 THEN '022 2200 ' || lpad({_U}, 4, '0')
    WHEN 4 THEN CASE event_id % 5 WHEN 0 THEN 'INVALID_PHONE_TEXT' WHEN 1 THEN '+0 98200 ' || lpad({_U}, 5, '0') WHEN 2 THEN '+999 8200' || lpad({_U}, 5, '0')
      WHEN 3 THEN '+44 20 794' || lpad({_U}, 5, '0') ELSE '0091 98200 ' || lpad({_U}, 5, '0') END
    WHEN 5 THEN NULL WHEN 6 THEN ' '
    ELSE '+91-98200' || lpad({_U}, 5, '0') END AS phone,
  CASE event_id % 6
    WHEN 0 THEN 'https://www.shop' || {_U} || '.example.com/Locations/?utm_source=gmb&q=' || {_s('event_id % 4')} || '&b=#top'
    WHEN 1 THEN 'shop' || {_U} || '.example.com' WHEN 2 THEN 'not-a-valid-url-###' WHEN 3 THEN NULL
    WHEN 4 THEN ' HTTP://Shop' || {_U} || '.Example.com:8080/a;x=1?fbclid=9 ' ELSE '' END AS website,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN -1.5 ELSE value / 7.0 END AS rating,
  CASE WHEN event_id % 37 = 1 THEN '4.7' WHEN event_id % 37 = 2 THEN NULL
       ELSE {_s("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) - 10")} END AS review_count,
  CASE WHEN event_id % 2 = 0 THEN 'Open · Closes 8 pm' END AS opening_hours,
  'https://maps.example.com/maps/place/' || {_U} || '/@19.' || {_s('100 + user_id % 800')} || ',72.' || {_s('100 + event_id % 7')}
    || ',15z?cid=' || {_s('event_id % 501')} AS profile_url,
  CAST(CASE WHEN event_id % 19 = 0 THEN 95.0 WHEN event_id % 23 = 0 THEN 0.0 ELSE 19.0 + (user_id % 1000) / 1000.0 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 53 = 0 THEN NULL ELSE 72.0 + (event_id % 7) / 8.0 END AS DOUBLE) AS longitude,
  CASE WHEN event_id % 61 = 0 THEN 'EXTRACTION_FAILED' WHEN event_id % 3 = 0 THEN 'SUCCESS' END AS status,
  props AS raw_payload, CAST(ts AS TIMESTAMP) AS scraped_at,
  CASE extract(day FROM ts) % 4 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Springfield' ELSE 'Noida' END AS run_city
FROM events JOIN customer ON user_id = c_custkey
"""

_RUNS = f"""
SELECT 'run_' || {_s('c_custkey')} AS run_id, ' ' || {_CITY.format(k='c_nationkey')} AS city_input,
  lower({_CITY.format(k='c_nationkey')}) AS city, c_mktsegment AS category,
  CASE WHEN c_acctbal < 0 THEN 20 ELSE 10 + c_custkey % 40 END AS requested_limit,
  CASE c_custkey % 8 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'INTERRUPTED'
    WHEN 4 THEN 'COMPLETED' WHEN 5 THEN 'PARTIAL' WHEN 6 THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  CAST(CAST('2024-01-01 00:00:00' AS TIMESTAMP) + c_custkey * INTERVAL 37 SECOND AS TIMESTAMP) AS created_at,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST(CAST('2024-01-01 00:00:10' AS TIMESTAMP) + c_custkey * INTERVAL 37 SECOND AS TIMESTAMP) END AS started_at,
  CASE WHEN c_custkey % 8 > 3 THEN CAST(CAST('2024-01-01 00:00:20' AS TIMESTAMP) + c_custkey * INTERVAL 37 SECOND
    + (c_custkey % 300) * INTERVAL 1 SECOND AS TIMESTAMP) END AS completed_at,
  CASE WHEN c_custkey % 8 = 6 THEN CASE c_custkey % 5 WHEN 0 THEN 'BROWSER_START_FAILED: closed' WHEN 1 THEN 'NAVIGATION_FAILED: timeout'
    WHEN 2 THEN 'FEED_NOT_FOUND: none' WHEN 3 THEN 'disk full' ELSE 'Run was cancelled by user.' END END AS error_message
FROM customer
"""

# outcomes of single records; a run is one user's stream of events
_OUTCOMES = f"""
SELECT 'run_' || {_U} AS run_id, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'duplicate' ELSE 'saved' END AS outcome
FROM events
"""

_STATUS_LOG = f"""
SELECT 'run_' || {_U} AS run_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING'
    WHEN 'purchase' THEN CASE WHEN value < 20 THEN 'COMPLETED' WHEN value < 60 THEN 'PARTIAL' ELSE 'PAUSED' END
    ELSE CASE WHEN value < 20 THEN 'FAILED' WHEN value < 60 THEN 'CANCELLED' ELSE 'INTERRUPTED' END END AS status,
  CAST(ts AS TIMESTAMP) AS changed_at
FROM events
"""

_REQUESTS = f"""
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE ' ' || {_CITY.format(k='c_nationkey')} || ' ' END AS city,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment END AS category,
  CAST(floor(c_acctbal / 5) AS INT) AS requested_limit, c_acctbal / 9000.0 AS confidence_threshold
FROM customer
"""

# two sources of businesses to match: customers are listings, suppliers a platform
_NAME_WORD = """CASE {k} % 6 WHEN 0 THEN 'royal cuts salon' WHEN 1 THEN 'hair castle' WHEN 2 THEN 'quiet spa studio'
  WHEN 3 THEN 'corner barber' WHEN 4 THEN 'luxe parlour mall' ELSE 'wellness clinic' END"""


def _side(key: str, nation: str, table: str, right: bool) -> str:
    k = "k"
    shown = f"CASE WHEN {k} % 4 = 1 THEN 'the ' ELSE '' END" if right else "''"
    road = "'rd'" if right else "'road'"
    # some records are copies of others under ids of their own
    return f"""
SELECT {_s(f'{k} + shift')} AS id, 'run_' || {_s(f'{k} % 3')} AS run_id,
  {shown} || {_NAME_WORD.format(k=k)} || ' ' || {_s(k)} AS normalized_name,
  CASE WHEN {k} % 5 = {1 if right else 0} THEN NULL ELSE '+91982' || lpad({_s(k)}, 7, '0') END AS normalized_phone,
  CASE WHEN {k} % 7 = {1 if right else 0} THEN NULL ELSE 'shop' || {_s(f'{k} % 60')} || '.example.com' END AS website_domain,
  {_s(f'{k} % 90')} || ' mg ' || {road} || ', ' || CASE WHEN {k} % 3 = 0 THEN 'west wing' ELSE 'bandra' END AS address,
  lower({_CITY.format(k='n' if not right else k)}) AS city, {_s(f'400001 + {k} % 25')} AS postal_code,
  CASE {k} % {7 if right else 6} WHEN 0 THEN 'hairdresser' WHEN 1 THEN 'salon' WHEN 2 THEN 'garage' WHEN 3 THEN 'car dealer' WHEN 4 THEN 'kiosk' ELSE 'tyre shop' END AS category,
  CASE WHEN {k} % 3 = 0 THEN 'instagram.com/shop' || {_s(k)} END AS social,
  CAST(19.0 + ({k} % 1000) / 1000.0 AS DOUBLE) AS latitude, CAST(72.0 + ({k} % {9 if right else 11}) / 100.0 AS DOUBLE) AS longitude
FROM (SELECT {key} AS k, {nation} AS n, 0 AS shift FROM {table}
  UNION ALL SELECT {key}, {nation}, 10000000 FROM {table} WHERE {key} % 50 = 7
  UNION ALL SELECT {key}, {nation}, 20000000 FROM {table} WHERE {key} % 100 = 7) base
"""


_LEFT = _side("c_custkey", "c_nationkey", "customer", False)
_RIGHT = _side("s_suppkey", "s_nationkey", "supplier", True)

# availability checks of a listing (the ordering customer) over time
_SNAPSHOTS = f"""
SELECT {_s('o_custkey')} AS listing_id, o_orderkey AS check_id,
  CASE o_orderstatus WHEN 'O' THEN 'BOOKABLE' WHEN 'F' THEN 'NO_SLOTS' ELSE 'FAILED' END AS availability_status,
  CAST(o_orderdate AS TIMESTAMP) AS checked_at
FROM orders
"""

_PLATFORMS = f"""
SELECT {_s('s_suppkey')} AS platform_id, s_name AS name, s_acctbal >= 0 AS active, s_nationkey % 2 = 0 AS discovery_supported
FROM supplier
"""
_MAPPINGS = f"""
SELECT DISTINCT {_s('l_suppkey')} AS platform_id, p_type AS category, p_size % 2 = 0 AS enabled
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
_PLATFORM_RESULTS = f"""
SELECT DISTINCT {_s('o_custkey')} AS business_id, {_s('l_suppkey')} AS platform_id,
  CASE o_orderstatus WHEN 'O' THEN 'found' WHEN 'F' THEN 'none' ELSE 'error' END AS outcome, l_discount * 1000 AS score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

# one row per business, field and source that offers a value
_CANDIDATES = f"""
SELECT {_s('c_custkey')} AS business_id, 'phone' AS field, 'google' AS source,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '+91982' || lpad({_s('c_custkey')}, 7, '0') END AS value FROM customer
UNION ALL SELECT {_s('o_custkey')}, 'phone', 'website', '+91982' || lpad({_s('o_custkey + o_orderkey % 2')}, 7, '0') FROM orders
UNION ALL SELECT {_s('o_custkey')}, 'email', CASE o_orderstatus WHEN 'O' THEN 'website' WHEN 'F' THEN 'platform' ELSE 'other' END,
  'info' || {_s('o_orderkey % 4')} || '@shop' || {_s('o_custkey')} || '.example.com' FROM orders
UNION ALL SELECT {_s('c_custkey')}, 'address', 'platform', {_s('c_nationkey')} || ' mg road' FROM customer
"""

_PROFILES = f"""
SELECT {_s('c_custkey')} AS business_id, 'run_' || {_s('c_custkey % 3')} AS run_id, c_name AS name,
  CASE WHEN c_custkey % 3 <> 0 THEN '+91982' || lpad({_s('c_custkey')}, 7, '0') END AS phone,
  CASE WHEN c_custkey % 4 <> 0 THEN 'info@shop' || {_s('c_custkey')} || '.example.com' END AS email,
  CASE WHEN c_custkey % 5 <> 0 THEN 'https://www.instagram.com/shop' || {_s('c_custkey')} END AS instagram,
  CASE WHEN c_custkey % 6 <> 0 THEN 'https://shop' || {_s('c_custkey')} || '.example.com/' END AS website,
  CASE WHEN c_custkey % 7 <> 0 THEN {_s('c_nationkey')} || ' mg road' END AS address,
  CASE WHEN c_custkey % 2 = 0 THEN 'mumbai' END AS city, CASE WHEN c_custkey % 9 <> 0 THEN '400001' END AS postal_code,
  CASE c_nationkey % 3 WHEN 0 THEN 'MISSING_ONLY' WHEN 1 THEN 'ALWAYS' ELSE 'NEVER' END AS mode,
  CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal / 100.0 END AS match_score
FROM customer
"""

# pages with the contact links a business site carries next to its own text
_SITES = f"""
SELECT page_id, url,
  html || '<footer><a href="mailto:Info' || {_s('page_id')} || '@Shop.example.com?subject=x">mail</a>'
  || '<a href="tel:+91 98200 ' || lpad({_s('page_id')}, 5, '0') || '">call</a>'
  || '<a href="https://www.instagram.com/shop' || {_s('page_id')} || '/?hl=en">ig</a>'
  || '<a href="http://m.facebook.com/shop' || {_s('page_id % 7')} || '">fb</a>'
  || '<a href="https://twitter.com/shop' || {_s('page_id')} || '?s=1">x</a>'
  || '<script type="application/ld+json">' || '{{"@type":"Store","telephone":"098200' || lpad({_s('page_id')}, 5, '0')
  || '","email":"hello@shop' || {_s('page_id')} || '.example.com"}}' || '</script>Desk' || {_s('page_id % 50')} || '&#64;shop.example.net.</footer>'
  || '<p>Write to Sales' || {_s('page_id')} || '@shop.example.org, desk' || {_s('page_id % 50')} || '@shop.example.net or nobody@localhost</p>'
  || CASE page_id % 4 WHEN 0 THEN '<script type="application/ld+json">{{ "@graph" : [ {{"@type": "Store", "name": "say ' || chr(92) || '"email' || chr(92) || '": x", "contactPoint": [{{"telephone": ["022 2200 '
       || lpad({_s('page_id')}, 4, '0') || '", 5], "email": "mailto:Care' || {_s('page_id')} || '@Shop.example.com"}}]}}, [{{"sameAs": ["https://www.linkedin.com/company/shop' || {_s('page_id')}
       || '/", "https://shop.example.com/me"], "email": null}}] ] }}</script>'
     WHEN 1 THEN '<script type="application/ld+json">[{{"sameAs": "https://youtube.com/@shop' || {_s('page_id')} || '", "telephone": {{"telephone": "1800 11"}}}}]</script>'
     WHEN 2 THEN '<script type="application/ld+json">{{"telephone": "unreadable</script>' ELSE '' END AS html
FROM pages
""".replace("{{", "{").replace("}}", "}")

_CARDS = f"""
SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 'Hair Castle ' ELSE 'Quiet Spa ' END || {_s('conv_id')} || chr(10)
  || CASE turn % 4 WHEN 0 THEN '4.7 (1,' || lpad({_s('conv_id % 1000')}, 3, '0') || ')' WHEN 1 THEN '4.5 ★ 80 reviews' WHEN 2 THEN '5.0' ELSE CASE conv_id % 3 WHEN 0 THEN '4.७ (12)' ELSE 'New' END END || chr(10)
  || CASE conv_id % 4 WHEN 0 THEN 'Day Spa · ₹₹ · 12 Linking Road, Bandra' WHEN 1 THEN 'Barber • Open now'
     WHEN 2 THEN '4.2 stars | Fort' ELSE 'Salon' END || chr(10)
  || CASE conv_id % 5 WHEN 0 THEN '098765 43210' WHEN 1 THEN '+91 98765 43210' WHEN 2 THEN '022 2200 1234'
     WHEN 3 THEN 'near City Chowk' ELSE '9८७६५ ४३२१० · 4.५' END || chr(10)
  || CASE turn % 3 WHEN 0 THEN 'Open · Closes 8 pm' WHEN 1 THEN 'Opens tomorrow' ELSE '' END || chr(10) || text AS body,
  CASE WHEN conv_id % 3 = 0 THEN 'tel:098200' || lpad({_s('conv_id')}, 5, '0') END AS tel_href,
  CASE WHEN conv_id % 2 = 0 THEN 'Phone: 98201 ' || lpad({_s('conv_id')}, 5, '0') END AS call_label,
  CASE conv_id % 3 WHEN 0 THEN 'https://www.google.com/url' WHEN 1 THEN 'https://shop.example.com/' || {_s('conv_id')} END AS website_href,
  CASE WHEN turn % 2 = 0 THEN '4.1 stars 1,234 Reviews' WHEN conv_id % 2 = 0 THEN '४.५ stars १२३ reviews' END AS aria_label
FROM conversations
"""

_LINKS = f"""
SELECT page_id, CASE page_id % 7
  WHEN 0 THEN 'https://maps.example.com/maps/place/A/data=!4m7!3m6!1s0x3be' || {_s('page_id')} || ':0x37!8m2!3d19.17' || {_s('page_id')}
    || '!4d72.96' || {_s('page_id')} || '!19sChIJ' || {_s('page_id')} || '-x_Q?authuser=0'
  WHEN 1 THEN url || '&place_id=ChIJ' || {_s('page_id')} WHEN 2 THEN url || '?ftid=0x1:' || {_s('page_id')}
  WHEN 3 THEN '/maps/place/x/data=!1s0xab' || {_s('page_id')} || ':0x9!3d-1.5'
  WHEN 4 THEN 'https://maps.example.com/maps/place/' || replace(url, '/', '+') || '/@-19.0' || {_s('page_id')} || ',72.5,15z'
  WHEN 5 THEN '/@१९.५,72.5' ELSE url END AS link
FROM pages
"""

VIEWS = {
    "v_listings": _LISTINGS, "v_runs": _RUNS, "v_outcomes": _OUTCOMES, "v_status_log": _STATUS_LOG,
    "v_requests": _REQUESTS, "v_left": _LEFT, "v_right": _RIGHT, "v_snapshots": _SNAPSHOTS,
    "v_platforms": _PLATFORMS, "v_mappings": _MAPPINGS, "v_platform_results": _PLATFORM_RESULTS,
    "v_candidates": _CANDIDATES, "v_profiles": _PROFILES, "v_sites": _SITES, "v_cards": _CARDS,
    "v_links": _LINKS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; test tables enter as SQL arguments."""
    sql = VIEWS[name]
    used = [t for t in TABLES if f" {t}\n" in sql + "\n" or f" {t} " in sql]
    wide = {"v_listings": "events", "v_cards": "conversations", "v_sites": "pages"}.get(name)
    sources = {t: table(spark, sf_dir, t) for t in used}
    if wide:  # the views whose rows go through the cleaning expressions
        sources[wide] = spread(sources[wide])
    return spark.sql(_braced(sql, used), **sources)


def _braced(sql: str, used: list[str]) -> str:
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return text


def with_views(sql: str, *names: str) -> str:
    """SQL for the other engine: the derived tables it uses as a WITH list."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
