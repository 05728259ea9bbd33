"""SQL fragments for the checking engine, written apart from the Spark code."""

from __future__ import annotations

import re

from entitymill import vocabulary as V
from entitymill.plans.derived import with_views


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def text(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def name(x: str) -> str:
    out = f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"
    out = f"regexp_replace({out}, '\\s*&\\s*', ' and ', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for suffix in V.LEGAL_SUFFIXES:
        out = f"trim(regexp_replace({out}, '\\b{suffix.replace('.', '')}$', ''))"
    return f"coalesce({out}, '')"


def label(x: str, prefix: str) -> str:
    return f"nullif({strip(f'''regexp_replace({strip(x)}, '(?i)^{prefix}[\\s:]*', '')''')}, '')"


# every number of up to three digits that is a country code
_CODES = "[" + ", ".join(f"'{n}'" for n in range(1, 1000) if re.fullmatch(V.PHONE_COUNTRY.removeprefix("^"), str(n))) + "]"


def phone_ctes(source: str, column: str, keep: str) -> str:
    """CTEs ending in ``phones``: kept columns, e164, phone_status."""
    national = "(?:000800|[2-9]\\d\\d)\\d{7}|1\\d{7,12}"
    return f"""
p1 AS (SELECT *, {column} AS _raw, {strip(f"regexp_replace({strip(column)}, '(?i)^(phone|tel|contact|mobile|call)[\\s:]*', '')")} AS _c FROM {source}),
p2 AS (SELECT *, regexp_replace(regexp_extract(_c, '(?s)[+0-9].*$'), '(?i)[\\s;,]*(?:extn?\\.?|ext\\.|x|#)[\\s.:]*[0-9]{{1,7}}$', '') AS _b FROM p1),
p3 AS (SELECT *, CASE WHEN len(regexp_replace(_b, '[^A-Za-z]', '', 'g')) >= 3
  THEN translate(upper(_b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999') ELSE _b END AS _t FROM p2),
p4 AS (SELECT *, regexp_replace(_t, '[^0-9]', '', 'g') AS _d, len(regexp_replace(_b, '[^0-9]', '', 'g')) >= 3 AS _ok FROM p3),
p5 AS (SELECT *, CASE WHEN _d[1:2] = '00' THEN _d[3:] WHEN _t[1] = '+' THEN _d END AS _i, regexp_replace(_c, '[^0-9]', '', 'g') AS _bare FROM p4),
p6 AS (SELECT *, CASE WHEN _i IS NOT NULL THEN _i[3:]
  WHEN _d[1:2] = '91' AND ((NOT regexp_full_match(_d, '{national}') AND regexp_full_match(_d[3:], '{national}')) OR len(_d) > 13) THEN _d[3:]
  ELSE _d END AS _s FROM p5),
p7 AS (SELECT *, CASE WHEN _s[1] = '0' AND NOT (regexp_full_match(_s, '{national}') AND NOT regexp_full_match(_s[2:], '{national}'))
  THEN _s[2:] ELSE _s END AS _n FROM p6),
phones AS (SELECT {keep}, CASE WHEN {blank('_raw')} OR NOT _ok THEN NULL
  WHEN _i IS NOT NULL AND NOT (list_contains({_CODES}, _i[1:1]) OR list_contains({_CODES}, _i[1:2]) OR list_contains({_CODES}, _i[1:3]))
    THEN CASE WHEN len(_bare) = 10 AND _bare[1] >= '6' THEN '+91' || _bare WHEN len(_bare) = 12 AND _bare[1:2] = '91' AND _bare[3] >= '6' THEN '+' || _bare
      WHEN len(_bare) = 11 AND _bare[1] = '0' AND _bare[2] >= '6' THEN '+91' || _bare[2:] END
  WHEN (_i IS NULL OR _i[1:2] = '91') THEN CASE WHEN len(_n) BETWEEN 6 AND 13 THEN '+91' || _n END
  WHEN regexp_full_match(_i, '[1-9][0-9]{{6,14}}') THEN '+' || _i END AS e164, {blank('_raw')} AS _blank FROM p7),
phoned AS (SELECT * EXCLUDE (_blank), CASE WHEN _blank THEN 'MISSING' WHEN e164 IS NULL THEN 'INVALID' ELSE 'FOUND' END AS phone_status FROM phones)"""


def url_ctes(source: str, column: str, keep: str) -> str:
    """CTEs ending in ``urled``: kept columns, url, domain, url_status."""
    decoded = lambda x: f"url_decode(replace({x}, '+', ' '))"
    coded = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return f"""
w1 AS (SELECT *, {column} AS _w, CASE WHEN regexp_matches({strip(column)}, '(?i)^https?://') THEN {strip(column)}
  ELSE 'https://' || {strip(column)} END AS _full FROM {source}),
w2 AS (SELECT *, regexp_extract(_full, '(?s)^([a-zA-Z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS _x FROM w1),
w3 AS (SELECT *, lower(_x.host) AS _h, rtrim(regexp_replace(_x.path, ';[^/]*$', ''), '/') AS _p,
  list_filter(string_split(_x.query, '&'), lambda q: contains(q, '=') AND split_part(q, '=', 2) <> '') AS _q FROM w2),
w4 AS (SELECT *, split_part(regexp_replace(_h, '^www\\.', ''), ':', 1) AS _dom,
  list_transform(list_filter(_q, lambda q: NOT (starts_with(lower({decoded("split_part(q, '=', 1)")}), 'utm_')
    OR lower({decoded("split_part(q, '=', 1)")}) IN ('gclid', 'fbclid'))),
    lambda q: {coded(decoded("split_part(q, '=', 1)"))} || '=' || {coded(decoded("q[instr(q, '=') + 1:]"))}) AS _kept FROM w3),
w5 AS (SELECT *, lower(_x.scheme) || '://' || _h || _p || CASE WHEN len(_kept) > 0 THEN '?' || array_to_string(_kept, '&') ELSE '' END AS _u,
  NOT {blank('_w')} AND regexp_matches(_dom, '\\.[a-zA-Z]{{2,}}$') AS _found FROM w4),
urled AS (SELECT {keep}, CASE WHEN _found THEN CASE WHEN _p = '' AND _u NOT LIKE '%/' THEN _u || '/' ELSE _u END END AS url,
  CASE WHEN _found THEN _dom END AS domain,
  CASE WHEN {blank('_w')} THEN 'MISSING' WHEN _found THEN 'FOUND' ELSE 'INVALID' END AS url_status FROM w5)"""


def address_ctes(source: str, column: str, city: str, keep: str) -> str:
    """CTEs ending in ``addressed``: kept columns and the address parts."""
    names = text([k for k, _ in V.STATES])
    canon = text([v for _, v in V.STATES])
    cities = text(sorted(V.CITIES, key=lambda n: (-len(n), n)))
    pin = "\\b[1-9][0-9]{5}\\b"
    locality = "|".join(V.LOCALITY_WORDS)
    through = "|".join(V.THOROUGHFARE_WORDS)
    less = lambda p, n, b: (
        f"trim(regexp_replace(regexp_replace({p}, '(?i){b}' || regexp_escape({n}) || '{b}', '', 'g'), '{pin}', '', 'g'), ' -,' || chr(10))"
    )
    without = lambda p, n, b: (
        f"CASE WHEN {n} IS NULL OR NOT contains(lower({p}), lower({n})) OR NOT regexp_matches({p}, '(?i){b}' || regexp_escape({n}) || '{b}') THEN {p} ELSE {less(p, n, b)} END"
    )
    return f"""
a1 AS MATERIALIZED (SELECT *, {city} AS _c0, CASE WHEN NOT {blank(column)} THEN
  {strip(f"regexp_replace({strip(column)}, '(?i)^(address|addr|loc|location)[\\s:]*', '')")} END AS _adt FROM {source}),
a2 AS MATERIALIZED (SELECT *, regexp_replace(_adt, '{pin}', '', 'g') AS _np,
  {canon}[list_position({names}, list_filter(list_filter({names}, lambda n: contains(lower(_adt), n)), lambda n: regexp_matches(lower(_adt), '\\b' || n || '\\b'))[1])] AS _st FROM a1),
a3 AS MATERIALIZED (SELECT *, CASE WHEN _adt IS NULL THEN _c0 WHEN coalesce(_c0, '') <> '' AND contains(lower(_np), lower(_c0)) AND regexp_matches(_np, '(?i)\\b' || regexp_escape(_c0) || '\\b') THEN _c0
  ELSE coalesce(array_to_string(list_transform(string_split(list_filter(list_filter({cities}, lambda n: contains(lower(_np), n)), lambda n: regexp_matches(lower(_np), '\\b' || n || '\\b'))[1], ' '),
    lambda w: upper(w[1]) || w[2:]), ' '), _c0) END AS _ci,
  list_filter(list_transform(string_split_regex(_adt, '[,\\n|;]|(?:\\s+[-–—]\\s+)'), lambda p: {strip('p')}), lambda p: p <> '') AS _seg FROM a2),
a4 AS MATERIALIZED (SELECT *, list_reduce(list_transform(_seg, lambda p: [p]), lambda a, p: CASE WHEN regexp_full_match(p[1], '[\\d\\s&\\-/]+')
  THEN list_concat(a[:-2], [a[-1] || ', ' || p[1]]) ELSE list_concat(a, p) END, []::VARCHAR[]) AS _co FROM a3),
a5 AS MATERIALIZED (SELECT *, list_filter(_co, lambda p: NOT regexp_full_match(p, '[1-9][0-9]{{5}}') AND lower(p) NOT IN ('india', 'bharat')) AS _f1 FROM a4),
a6 AS MATERIALIZED (SELECT *, list_filter(list_transform(_f1, lambda p: {without('p', '_st', '')}), lambda p: p <> '') AS _f2 FROM a5),
a7 AS MATERIALIZED (SELECT *, list_filter(list_transform(_f2, lambda p: {without('p', '_ci', chr(92) + 'b')}), lambda p: p <> '') AS _f3 FROM a6),
a8 AS MATERIALIZED (SELECT *, coalesce(_ci, '') = '' AND len(_f3) > 0 AND NOT regexp_matches(lower(_f3[-1]), 'road|marg|lane|street|shop') AS _tk FROM a7),
a9 AS MATERIALIZED (SELECT * EXCLUDE (_ci, _f3), CASE WHEN _tk THEN _f3[-1] ELSE _ci END AS _ci, CASE WHEN _tk THEN _f3[:-2] ELSE _f3 END AS _f3 FROM a8),
a10 AS MATERIALIZED (SELECT *, regexp_extract(_f3[1], '(?is)^(.*?\\b(?:{through})\\b)(.*)$', ['head', 'tail']) AS _g,
  CASE WHEN len(_f3) >= 4 AND regexp_matches(lower(_f3[-2]), '{locality}') THEN 2 ELSE 1 END AS _k,
  regexp_matches(_f3[1], '(?i)\\b(shop|flat|building|bldg|plot|floor|complex|plaza|no\\.)\\b') AS _pr,
  regexp_matches(lower(_f3[1]), '{locality}') AS _lo FROM a9),
addressed AS MATERIALIZED (SELECT {keep},
  CASE WHEN len(_f3) = 1 THEN CASE WHEN _g.head <> '' AND trim(_g.tail, ' ,-–') <> '' THEN {strip('_g.head')}
      WHEN _g.head = '' AND NOT _pr AND _lo THEN NULL ELSE _f3[1] END
    WHEN len(_f3) > 1 THEN array_to_string(_f3[:len(_f3) - _k], ', ') END AS street,
  CASE WHEN len(_f3) = 1 THEN CASE WHEN _g.head <> '' AND trim(_g.tail, ' ,-–') <> '' THEN trim(_g.tail, ' ,-–')
      WHEN _g.head = '' AND NOT _pr AND _lo THEN _f3[1] END
    WHEN len(_f3) > 1 THEN array_to_string(_f3[len(_f3) - _k + 1:], ', ') END AS locality,
  coalesce(nullif(_ci, ''), _c0) AS city, _st AS state, nullif(regexp_extract(_adt, '{pin}'), '') AS postal_code, 'India' AS country FROM a10)"""


def coordinates(lat: str, lon: str) -> tuple[str, str]:
    ok = f"({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT ({lat} = 0 AND {lon} = 0))"
    return f"CASE WHEN {ok} THEN round({lat}, 7) END", f"CASE WHEN {ok} THEN round({lon}, 7) END"


def listings_cte() -> str:
    """CTEs ending in ``biz`` (valid canonical rows) and ``checked`` (all rows)."""
    lat, lon = coordinates("latitude", "longitude")
    return f"""
l0 AS (SELECT *, nullif({strip('name')}, '') AS clean_name, {name('name')} AS normalized_name FROM v_listings),
{phone_ctes('l0', 'phone', '*')},
{url_ctes('phoned', 'website', '*')},
{address_ctes('urled', 'address', 'run_city', '*')},
checked AS MATERIALIZED (SELECT *, CASE WHEN {blank('name')} THEN 'Business name is missing or empty'
  WHEN normalized_name = '' THEN 'Normalized business name is empty' END AS error,
  coalesce(nullif(status, ''), 'SUCCESS') = 'EXTRACTION_FAILED' AS extraction_failed FROM addressed),
biz AS MATERIALIZED (SELECT run_id, seq, clean_name AS name, normalized_name, category, address, street, locality, city, state, postal_code, country,
  {lat} AS latitude, {lon} AS longitude, phone, e164 AS normalized_phone, phone_status, coalesce(url, website) AS website, domain AS website_domain,
  url_status AS website_status, website AS raw_website, CASE WHEN rating BETWEEN 0 AND 5 THEN round(rating, 2) END AS rating,
  CASE WHEN regexp_full_match(review_count, '-?\\d+') AND CAST(review_count AS INT) >= 0 THEN CAST(review_count AS INT) END AS review_count,
  place_id AS google_place_id, profile_url AS google_profile_url, opening_hours, scraped_at
  FROM checked WHERE error IS NULL AND NOT extraction_failed)"""


def keys_cte(source: str = "biz") -> str:
    """CTE ``recs``: per record its probe keys (with rank) and held keys."""
    k = lambda *xs: "'" + xs[0] + "' || chr(1) || " + " || chr(1) || ".join(xs[1:])
    phone = "coalesce(nullif(phone, ''), nullif(normalized_phone, ''))"
    dom, postal, addr = (f"nullif({strip(c)}, '')" for c in ("website_domain", "postal_code", "address"))
    place = "nullif(google_place_id, '')"
    empty = "CASE WHEN google_place_id = '' THEN '-' END"
    probes = [k("1", place), k("2", "normalized_name", "city", phone), k("3", "normalized_name", "city", dom),
              k("4", "normalized_name", "city", postal), k("5", "normalized_name", addr), k("6", empty)]
    holds = [k("1", place), k("2", "normalized_name", "city", "phone"), k("2", "normalized_name", "city", "normalized_phone"),
             k("3", "normalized_name", "city", "website_domain"), k("4", "normalized_name", "city", "postal_code"),
             k("5", "normalized_name", "address"), k("6", empty)]
    some = "list_filter([{}], lambda z: z IS NOT NULL)".format
    return f"""recs AS (SELECT run_id, seq, {some(', '.join(probes))} AS probes, {some(', '.join(holds))} AS holds FROM {source}),
greedy AS (SELECT run_id, list_reduce(list({{'seq': seq, 'p': probes, 'h': holds}} ORDER BY seq),
  lambda a, r: CASE WHEN list_has_any(a.held, r.p) THEN a ELSE {{'held': list_concat(a.held, r.h), 'kept': list_append(a.kept, r.seq)}} END,
  {{'held': []::VARCHAR[], 'kept': []::BIGINT[]}}).kept AS kept FROM recs GROUP BY run_id),
kept AS (SELECT run_id, unnest(kept) AS seq FROM greedy),
held AS (SELECT run_id, seq, unnest(holds) AS key FROM recs SEMI JOIN kept USING (run_id, seq)),
lost AS (SELECT run_id, seq, unnest(probes) AS key FROM recs ANTI JOIN kept USING (run_id, seq)),
why AS (SELECT l.run_id, l.seq, min({{'rank': CAST(l.key[1] AS INT), 'of': h.seq}}) AS w
  FROM lost l JOIN held h ON l.run_id = h.run_id AND l.key = h.key AND h.seq < l.seq GROUP BY 1, 2)"""


def listings(tail: str, *more: str, views: tuple[str, ...] = ("v_listings",)) -> str:
    """Statement over the cleaned listings; ``more`` are further CTEs."""
    return with_views("\x00", *views).replace(" \x00", ", " + ", ".join([listings_cte(), *more]) + " ") + tail
