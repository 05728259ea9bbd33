"""Matching, platforms, enrichment, merging and exported datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from entitymill import vocabulary as V
from entitymill.functions.similarity import address_tokens
from entitymill.functions.web import normalize_email, social_network
from entitymill.operators import dedup, enrichment, matching, merge, platforms, ranking
from entitymill.plans import duck
from entitymill.plans.cleaning_queries import canonical
from entitymill.plans.derived import table, view, with_views
from entitymill.plans.registry import query
from entitymill.plans.run_queries import _COUNTS, _counted
from entitymill.session import cut_lineage, ensure_checkpoint_dir


def _over(tail: str, *views: str, ctes: str = "") -> str:
    return with_views("\x00", *views).replace(" \x00", (", " + ctes if ctes else "") + " ") + tail


# --- matching: customers against suppliers, by brute force on the checking side ------

# the lowest threshold asked for below is 60, with a margin of 5
FLOOR = 55.0

_TOKENS = "list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"
_SPELLED = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STREET_ABBREVIATIONS.items()) + " ELSE w END"
_MEANING = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CATEGORY_SYNONYMS.items()) + " END"
_JACCARD = "CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def _side(name: str, source: str) -> str:
    words = _TOKENS.format(x="address")
    return (f"{name} AS MATERIALIZED (SELECT *, {_TOKENS.format(x='normalized_name')} AS nt, list_distinct(string_split(array_to_string(list_transform({words}, "
            f"lambda w: {_SPELLED}), ' '), ' ')) AS at_, {_MEANING.format(x='category')} AS meaning FROM {source})")


_EQ = "CASE WHEN l.{c} = r.{c} THEN 1.0 ELSE 0.0 END"
_LEV = "CASE WHEN greatest(len(l.normalized_name), len(r.normalized_name)) = 0 THEN 0.0 ELSE 1.0 - levenshtein(l.normalized_name, r.normalized_name) / greatest(len(l.normalized_name), len(r.normalized_name)) END"
_SCORED = f"""{_side('a', 'v_left')}, {_side('b', 'v_right')},
pairs AS MATERIALIZED (SELECT l.run_id, l.id AS l_id, r.id AS r_id, l.category AS l_category, r.category AS r_category,
  CAST({_EQ.format(c='normalized_phone')} AS DOUBLE) AS phone_score, CAST({_EQ.format(c='website_domain')} AS DOUBLE) AS domain_score,
  CAST(greatest({_JACCARD.format(a='l.nt', b='r.nt')}, {_LEV}) AS DOUBLE) AS name_score, CAST({_JACCARD.format(a='l.at_', b='r.at_')} AS DOUBLE) AS address_score,
  CAST({_EQ.format(c='city')} AS DOUBLE) AS city_score, CAST(CASE WHEN l.category = r.category THEN 1.0 WHEN l.meaning = r.meaning THEN 0.8 ELSE 0.0 END AS DOUBLE) AS category_score,
  CAST({_EQ.format(c='social')} AS DOUBLE) AS social_score FROM a l JOIN b r ON l.run_id = r.run_id),
weighted AS MATERIALIZED (SELECT *, round(25 * phone_score + 20 * domain_score + 20 * name_score + 20 * address_score + 5 * city_score + 5 * category_score + 5 * social_score, 6) AS score FROM pairs),
scored AS MATERIALIZED (SELECT * FROM weighted WHERE score >= {FLOOR})"""

# reports hold the pairs of these blocks too, whatever they score
_NEAR = """coalesce(right(l.normalized_phone, 7) = right(r.normalized_phone, 7), FALSE) OR coalesce(l.website_domain = r.website_domain, FALSE)
    OR coalesce(l.city = r.city AND (left(l.normalized_name, 4) = left(r.normalized_name, 4) OR coalesce(l.meaning, l.category) = coalesce(r.meaning, r.category)), FALSE) AS near"""
_REPORTED = _SCORED.replace(" AS social_score FROM", f" AS social_score,\n  {_NEAR} FROM").replace(f"WHERE score >= {FLOOR})", f"WHERE score >= {FLOOR} OR near)")


def _decided(side: str, other: str, source: str, threshold: float = 80, reported: bool = False) -> str:
    least = "" if reported else f" WHERE score >= {min(threshold, V.MATCH_THRESHOLD) - V.AMBIGUITY_MARGIN}"
    return f"""ranked_{side} AS (SELECT {side}_id AS id, {other}_id AS best_id, score, row_number() OVER (PARTITION BY {side}_id ORDER BY score DESC, {other}_id) AS n,
  lead(score) OVER (PARTITION BY {side}_id ORDER BY score DESC, {other}_id) AS nxt FROM scored{least}),
decided_{side} AS MATERIALIZED (SELECT s.id, s.run_id, k.best_id, k.score AS best_score, CASE WHEN k.id IS NOT NULL THEN coalesce(k.nxt, 0.0) END AS second_score,
  CAST({threshold} AS DOUBLE) AS threshold,
  CASE WHEN k.score IS NULL OR k.score < {threshold} THEN 'UNMATCHED' WHEN k.score - coalesce(k.nxt, 0) >= 5 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS decision,
  CASE WHEN k.score IS NULL THEN 'NO_CANDIDATE' WHEN k.score < {threshold} THEN 'BELOW_THRESHOLD' WHEN k.score - coalesce(k.nxt, 0) < 5 THEN 'AMBIGUOUS_CANDIDATES' END AS reason
  FROM {source} s LEFT JOIN ranked_{side} k ON k.id = s.id AND k.n = 1)"""


def _unmatched(side: str, other: str) -> str:
    """Records without a match and the best of all pairs of their run."""
    return f"""best_{side} AS (SELECT {side}_id AS id, {other}_id AS best_id, score AS best_score FROM weighted QUALIFY row_number() OVER (PARTITION BY {side}_id ORDER BY score DESC, {other}_id) = 1),
unmatched_{side} AS (SELECT d.id, d.run_id, b.best_id, b.best_score, d.threshold,
  CASE WHEN decision = 'AMBIGUOUS' THEN 'AMBIGUOUS_CANDIDATES' WHEN b.best_score IS NULL THEN 'NO_CANDIDATE' ELSE 'BELOW_THRESHOLD' END AS reason
  FROM decided_{side} d LEFT JOIN best_{side} b ON b.id = d.id WHERE decision <> 'MATCHED')"""


_SIDES = ("v_left", "v_right")
_LEFT_DECIDED, _RIGHT_DECIDED = _decided("l", "r", "v_left"), _decided("r", "l", "v_right")
_LEFT_REPORTED = _decided("l", "r", "v_left", reported=True)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "v_left"), view(spark, sf, "v_right")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records with all their columns: those at the floor and all of the report blocks."""
    left, right = sides(spark, sf)
    return matching.record_pairs(matching.score_pairs(left, right, FLOOR, reports=True), left, right)


def reported(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on the left side with the best of all reported pairs, below the threshold too."""
    left, right = sides(spark, sf)
    return matching.decisions(left, matching.score_pairs(left, right, FLOOR, reports=True))


def decided(spark: SparkSession, sf: str, side: str = "l", threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """Decisions from the pairs that a threshold depends on."""
    left, right = sides(spark, sf)
    return matching.decisions(left if side == "l" else right, matching.score_pairs(left, right, threshold - V.AMBIGUITY_MARGIN), side, threshold)


def unmatched(spark: SparkSession, sf: str, side: str = "l", made: DataFrame | None = None) -> DataFrame:
    """Records without a match, each with the best of all candidates of its run."""
    left, right = sides(spark, sf)
    mine, theirs = (left, right) if side == "l" else (right, left)
    made = cut_lineage(made if made is not None else decided(spark, sf, side))
    open_ = mine.join(made.filter("decision <> 'MATCHED'").select("id"), "id", "left_semi")
    return matching.with_best_candidates(made, ranking.best_candidates(open_, theirs))


_SCORES = ["phone_score", "domain_score", "name_score", "address_score", "city_score", "category_score", "social_score"]


@query("match_candidates_scored", "M-1 M-2 M-3 M-4", _over(
    "SELECT run_id, l_id, r_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in _SCORES) + ", score FROM scored", *_SIDES, ctes=_REPORTED))
def match_candidates_scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        F.col("l_run_id").alias("run_id"), "l_id", "r_id",
        *[F.round(s, 6).alias(s) for s in _SCORES], "score")


@query("address_tokens_spelled_out", "M-3", _over(
    "SELECT id, array_to_string(list_sort(at_), ' ') AS words FROM b", *_SIDES, ctes=f"{_side('b', 'v_right')}"))
def address_tokens_spelled_out(spark: SparkSession, sf: str) -> DataFrame:
    right = view(spark, sf, "v_right")
    return right.select("id", F.array_join(F.array_sort(address_tokens(F.col("address"))), " ").alias("words"))


@query("strong_identities", "M-5", _over(
    "SELECT l_id, r_id, phone_score = 1 AND city_score = 1 AS strong_phone, domain_score = 1 AND name_score >= 0.8 AS strong_domain FROM scored", *_SIDES, ctes=_REPORTED))
def strong_identities(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "l_id", "r_id", "strong_phone", "strong_domain")


@query("match_decisions", "M-6", _over("SELECT id, run_id, best_id, best_score, second_score, decision FROM decided_l", *_SIDES, ctes=f"{_REPORTED}, {_LEFT_REPORTED}"))
def match_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return reported(spark, sf).select("id", "run_id", "best_id", "best_score", "second_score", "decision")


@query("match_conflicts_resolved", "M-7", _over("""
SELECT id, best_id, CASE WHEN decision = 'MATCHED' AND row_number() OVER (PARTITION BY run_id, best_id, decision ORDER BY best_score DESC, id) > 1 THEN 'CONFLICT' ELSE decision END AS decision
FROM decided_l""", *_SIDES, ctes=f"{_REPORTED}, {_LEFT_REPORTED}"))
def match_conflicts_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return matching.resolve_conflicts(reported(spark, sf)).select("id", "best_id", "decision")


_LINES = " || '; ' || ".join(
    f"printf('{s}: %.2f%% x {w:g} = %.2f', {s}_score * 100, {s}_score * {w:g})" for s, w in V.MATCH_WEIGHTS.items())


@query("match_explanations", "M-8", _over(
    f"SELECT l_id, r_id, {_LINES} || '; ' || printf('total = %.2f%%', score) AS explanation FROM scored", *_SIDES, ctes=_REPORTED))
def match_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "l_id", "r_id", matching.explain().alias("explanation"))


@query("unmatched_listings", "M-9", _over(
    "SELECT id, best_id, best_score, threshold, reason FROM unmatched_l", *_SIDES, ctes=f"{_SCORED}, {_LEFT_DECIDED}, {_unmatched('l', 'r')}"))
def unmatched_listings(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched(spark, sf).select("id", "best_id", "best_score", "threshold", "reason")


@query("unmatched_platform_records", "M-9", _over(
    "SELECT id, best_id, best_score, threshold, reason FROM unmatched_r", *_SIDES, ctes=f"{_SCORED}, {_RIGHT_DECIDED}, {_unmatched('r', 'l')}"))
def unmatched_platform_records(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched(spark, sf, "r").select("id", "best_id", "best_score", "threshold", "reason")


def _rematched(threshold: int) -> str:
    return _over("SELECT id, threshold, decision, reason, 'second' AS evaluation FROM decided_l", *_SIDES, ctes=f"{_REPORTED}, {_decided('l', 'r', 'v_left', threshold, reported=True)}")


def _rematch(spark: SparkSession, sf: str, threshold: int) -> DataFrame:
    return matching.rematch(reported(spark, sf), threshold, "second").select("id", "threshold", "decision", "reason", "evaluation")


@query("rematch_at_new_threshold", "M-10", _rematched(95))
def rematch_at_new_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rematch(spark, sf, 95)


@query("rematch_at_70", "M-10", _rematched(70))
def rematch_at_70(spark: SparkSession, sf: str) -> DataFrame:
    return _rematch(spark, sf, 70)


@query("rematch_at_60", "M-10", _rematched(60))
def rematch_at_60(spark: SparkSession, sf: str) -> DataFrame:
    return _rematch(spark, sf, 60)


_HAV = "round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(r.latitude - l.latitude) / 2), 2) + cos(radians(l.latitude)) * cos(radians(r.latitude)) * pow(sin(radians(r.longitude - l.longitude) / 2), 2)))), 3)"


@query("best_candidate_distance", "M-11", _over(
    f"SELECT d.id, d.best_id, {_HAV} AS distance_km FROM decided_l d JOIN v_left l ON l.id = d.id JOIN v_right r ON r.id = d.best_id", *_SIDES, ctes=f"{_REPORTED}, {_LEFT_REPORTED}"))
def best_candidate_distance(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(spark, sf)
    at = lambda df, p, key: df.select(F.col("id").alias(key), F.col("latitude").alias(f"{p}_latitude"), F.col("longitude").alias(f"{p}_longitude"))
    pairs = reported(spark, sf).select("id", "best_id").join(at(left, "l", "id"), "id").join(at(right, "r", "best_id"), "best_id")
    return matching.pair_distance(pairs).select("id", "best_id", "distance_km")


# --- platforms -----------------------------------------------------------------------------

_REQUESTS = "req AS (SELECT DISTINCT p_type AS category, CASE WHEN p_type LIKE 'S%' THEN 'ALL' ELSE 'AUTO' END AS mode FROM part), " \
    "hand AS (SELECT DISTINCT p_type AS category, CAST(p_partkey % 11 AS STRING) AS platform_id FROM part)"


@query("selected_platforms", "P-1", _over("""
SELECT category, platform_id FROM ((SELECT m.category, m.platform_id FROM v_mappings m JOIN req USING (category) WHERE m.enabled AND mode <> 'ALL'
  UNION SELECT h.category, h.platform_id FROM hand h JOIN req USING (category) WHERE mode <> 'ALL')) JOIN v_platforms USING (platform_id) WHERE active
UNION ALL SELECT category, platform_id FROM req, v_platforms WHERE mode = 'ALL' AND active AND discovery_supported""", "v_mappings", "v_platforms", ctes=_REQUESTS))
def selected_platforms(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    requests = part.select(F.col("p_type").alias("category")).distinct().withColumn(
        "mode", F.when(F.col("category").startswith("S"), F.lit("ALL")).otherwise(F.lit("AUTO")))
    manual = part.select(F.col("p_type").alias("category"), (F.col("p_partkey") % 11).cast("string").alias("platform_id")).distinct()
    return platforms.select_platforms(requests, view(spark, sf, "v_mappings"), manual, view(spark, sf, "v_platforms"))


_PARENT = "CASE category WHEN 'garage' THEN 'car dealer' WHEN 'tyre shop' THEN 'vehicles' WHEN 'car dealer' THEN 'vehicles' WHEN 'kiosk' THEN 'Tyre Shop' END"


@query("category_relations", "P-2", _over(f"""
SELECT CASE WHEN l_category = r_category THEN 'EXACT' WHEN {_MEANING.format(x='l_category')} = {_MEANING.format(x='r_category')} THEN 'SYNONYM'
  WHEN lower(lt.parent) = r_category OR lower(rt.parent) = l_category THEN 'PARENT_CHILD_COMPATIBLE' WHEN lt.parent = rt.parent THEN 'RELATED'
  WHEN {_MEANING.format(x='l_category')} IS NOT NULL AND {_MEANING.format(x='r_category')} IS NOT NULL THEN 'CONFLICTING' ELSE 'UNKNOWN' END AS relation,
  count(*) AS pairs FROM scored LEFT JOIN tree lt ON lt.category = l_category LEFT JOIN tree rt ON rt.category = r_category GROUP BY 1""", *_SIDES,
                                            ctes=f"{_REPORTED}, tree AS (SELECT DISTINCT category, {_PARENT} AS parent FROM v_left)"))
def category_relations(spark: SparkSession, sf: str) -> DataFrame:
    tree = view(spark, sf, "v_left").select("category", F.expr(_PARENT).alias("parent")).distinct()
    pairs = matching.with_parents(scored(spark, sf), tree)
    relation = matching.category_relation(*[F.col(c) for c in ("l_category", "r_category", "l_category_parent", "r_category_parent")])
    return pairs.groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("pairs"))


@query("category_tree_totals", "P-3", """
WITH n AS (SELECT 'n' || CAST(n_nationkey AS STRING) AS id, 'r' || CAST(n_regionkey AS STRING) AS region, count(c_custkey) AS c
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT id, CAST(c AS BIGINT) AS total FROM n UNION ALL SELECT region, CAST(sum(c) AS BIGINT) FROM n GROUP BY 1 UNION ALL SELECT 'all', CAST(sum(c) AS BIGINT) FROM n""")
def category_tree_totals(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = nation.select(text("n", "n_nationkey").alias("id"), text("r", "n_regionkey").alias("parent_id")).unionByName(
        region.select(text("r", "r_regionkey").alias("id"), F.lit("all").alias("parent_id"))).unionByName(
        region.agg(F.lit("all").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    counts = table(spark, sf, "customer").groupBy(text("n", "c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return platforms.roll_up(tree, counts)


_RUN_PLATFORMS = "rp AS (SELECT 'run_' || CAST(CAST(platform_id AS BIGINT) % 3 AS STRING) AS run_id, platform_id FROM v_platforms WHERE active)"
_PRESENCE = f"""{_RUN_PLATFORMS}, best AS (SELECT business_id, platform_id, min(CASE WHEN outcome = 'found' AND score >= 50 THEN 1 WHEN outcome = 'found' THEN 2
  WHEN outcome = 'error' THEN 3 ELSE 4 END) AS k FROM v_platform_results GROUP BY 1, 2),
pres AS (SELECT b.business_id, rp.platform_id, coalesce(['PRESENT', 'UNCERTAIN', 'ERROR', 'NOT_FOUND'][k], 'UNCERTAIN') AS presence
  FROM v_profiles b JOIN rp USING (run_id) LEFT JOIN best ON best.business_id = b.business_id AND best.platform_id = rp.platform_id)"""


def presences(spark: SparkSession, sf: str) -> DataFrame:
    run_platforms = view(spark, sf, "v_platforms").filter("active").select(
        F.concat(F.lit("run_"), (F.col("platform_id").cast("bigint") % 3).cast("string")).alias("run_id"), "platform_id")
    return platforms.presence(view(spark, sf, "v_profiles"), run_platforms, view(spark, sf, "v_platform_results"))


@query("platform_presence", "P-4", _over("SELECT business_id, platform_id, presence FROM pres", "v_platforms", "v_platform_results", "v_profiles", ctes=_PRESENCE))
def platform_presence(spark: SparkSession, sf: str) -> DataFrame:
    return presences(spark, sf).select("business_id", "platform_id", "presence")


@query("availability_as_of", "P-5", _over("""
SELECT listing_id, checked_at, check_id, availability_status FROM v_snapshots WHERE checked_at <= TIMESTAMP '1998-06-30 00:00:00'
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY checked_at DESC, check_id DESC) = 1""", "v_snapshots"))
def availability_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return platforms.availability_as_of(view(spark, sf, "v_snapshots"), F.to_timestamp(F.lit("1998-06-30 00:00:00")))


@query("availability_at_shipping", "P-5", _over("""
, latest AS (SELECT * FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY listing_id, checked_at ORDER BY check_id DESC) = 1),
asked AS (SELECT l_orderkey, l_linenumber, CAST(o_custkey AS STRING) AS listing_id, CAST(l_shipdate AS TIMESTAMP) - INTERVAL 40 DAY AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT a.l_orderkey, a.l_linenumber, s.checked_at, s.check_id, s.availability_status FROM asked a ASOF LEFT JOIN latest s ON a.listing_id = s.listing_id AND a.at >= s.checked_at""",
                                             "v_snapshots").replace(") \n,", "),"))
def availability_at_shipping(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line with its customer's latest check 40 days before shipping, a time of its own each."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_custkey").cast("string").alias("listing_id"), (F.col("l_shipdate").cast("timestamp") - F.expr("interval 40 day")).alias("at"))
    return platforms.availability_at(lines, view(spark, sf, "v_snapshots")).select("l_orderkey", "l_linenumber", "checked_at", "check_id", "availability_status")


@query("common_envelope", "P-6", _over("""
SELECT 'listing' AS platform, id AS external_id, normalized_name AS name, city, normalized_phone AS phone, CAST(NULL AS STRING) AS profile_url FROM v_left
UNION ALL SELECT 'directory', id, normalized_name, NULL, normalized_phone, social FROM v_right""", *_SIDES))
def common_envelope(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(spark, sf)
    c = F.col
    return platforms.envelope({
        "listing": (left, {"external_id": c("id"), "name": c("normalized_name"), "city": c("city"), "phone": c("normalized_phone")}),
        "directory": (right, {"external_id": c("id"), "name": c("normalized_name"), "phone": c("normalized_phone"), "profile_url": c("social")}),
    })


# --- enrichment -----------------------------------------------------------------------------

_REQUESTED = ["phone", "email", "instagram"]
_STATES = """st AS (SELECT *, list_filter([CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN email IS NULL THEN 'email' END, CASE WHEN instagram IS NULL THEN 'instagram' END],
  lambda x: x IS NOT NULL) AS missing FROM v_profiles),
states AS (SELECT *, CASE WHEN mode = 'NEVER' THEN 'SKIPPED_NEVER_MODE' WHEN len(missing) = 0 AND mode = 'MISSING_ONLY' THEN 'SKIPPED_COMPLETE'
  WHEN website IS NULL THEN 'NO_WEBSITE' ELSE 'REQUIRED' END AS enrichment FROM st),
crawl AS (SELECT business_id, page, row_number() OVER (PARTITION BY business_id ORDER BY o) - 1 AS position FROM states,
  (VALUES ('homepage', 1), ('footer', 2), ('contact', 3), ('about', 4)) p(page, o)
  WHERE enrichment = 'REQUIRED' AND len(missing) > 0 AND (page <> 'footer' OR list_contains(missing, 'instagram')))"""


def enrichment_states(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.enrichment_state(view(spark, sf, "v_profiles"), _REQUESTED)


@query("enrichment_policy", "E-1", _over("SELECT business_id, array_to_string(missing, ',') AS missing, enrichment FROM states", "v_profiles", ctes=_STATES))
def enrichment_policy(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment_states(spark, sf).select("business_id", F.array_join("missing", ",").alias("missing"), "enrichment")


@query("crawl_plan", "E-2", _over("SELECT business_id, CAST(position AS INT) AS position, page FROM crawl", "v_profiles", ctes=_STATES))
def crawl_plan(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.crawl_plan(enrichment_states(spark, sf))


_CRAWLED = """res AS (SELECT business_id, (hash_id % 4 = 0) AS failed, CASE hash_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['phone', 'email', 'instagram'] ELSE ['phone'] END AS found
  FROM (SELECT business_id, CAST(business_id AS BIGINT) // 7 AS hash_id FROM crawl WHERE CAST(business_id AS BIGINT) % 7 <> 3)),
agg AS (SELECT business_id, bool_and(failed) AS failed, list_distinct(flatten(list(found))) AS found FROM res GROUP BY 1),
after AS (SELECT s.business_id, len(list_filter(s.missing, lambda m: list_contains(coalesce(a.found, []::VARCHAR[]), m))) AS recovered,
  CASE WHEN enrichment <> 'REQUIRED' OR a.failed IS NULL THEN enrichment WHEN a.failed THEN 'FAILED'
  WHEN len(list_filter(s.missing, lambda m: NOT list_contains(a.found, m))) = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS enrichment
  FROM states s LEFT JOIN agg a USING (business_id))"""


def after_crawl(spark: SparkSession, sf: str) -> DataFrame:
    states = enrichment_states(spark, sf)
    pages = enrichment.crawl_plan(states).filter("cast(business_id as bigint) % 7 <> 3").withColumn("_h", F.expr("cast(business_id as bigint) div 7 % 4"))
    results = pages.select(
        "business_id", "page", (F.col("_h") == 0).alias("failed"),
        F.expr("case _h when 0 then cast(array() as array<string>) when 1 then array('phone', 'email', 'instagram') else array('phone') end").alias("found"))
    return enrichment.after_crawl(states, results)


@query("enrichment_after_crawl", "E-1", _over("SELECT business_id, enrichment, CAST(recovered AS INT) AS recovered FROM after", "v_profiles", ctes=f"{_STATES}, {_CRAWLED}"))
def enrichment_after_crawl(spark: SparkSession, sf: str) -> DataFrame:
    return after_crawl(spark, sf).select("business_id", "enrichment", "recovered")


_LINKED = """
l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS a FROM v_sites),
j AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1)) AS b FROM v_sites),
tree AS (SELECT page_id, t.key, t.type, t.atom, t.value FROM (SELECT * FROM j WHERE json_valid(b)), json_tree(b) t WHERE t.key IN ('telephone', 'email', 'sameAs')),
said AS (SELECT page_id, key, json_extract_string(value, '$') AS v FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')
  UNION ALL SELECT page_id, key, unnest(json_extract_string(value, '$[*]')) FROM tree WHERE type = 'ARRAY' AND NOT contains(CAST(json_type(value, '$[*]') AS VARCHAR), 'OBJECT')),
plain AS (SELECT page_id, html, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM v_sites),
mails AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&#64;', '@'), '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,}'))) AS v FROM plain),
edge AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(replace(array_to_string(regexp_extract_all(h, '(?s)<footer>.*?</footer>'), ' '), '&#64;', '@'), '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,}'))) AS v
  FROM (SELECT page_id, regexp_replace(regexp_replace(h, '<a [^>]*>', ' ', 'g'), '</a>', ' ', 'g') AS h FROM plain))"""
_CONTACTS = """
SELECT page_id, 'email' AS kind, lower(split_part(split_part(a, ':', 2), '?', 1)) AS value, 'mailto_link' AS method, 0.9::DOUBLE AS confidence, NULL AS username FROM l WHERE a LIKE 'mailto:%'
UNION ALL SELECT page_id, 'phone', a[5:], 'tel_link', 0.9, NULL FROM l WHERE a LIKE 'tel:%'
UNION ALL SELECT page_id, kind, 'https://' || host || path, 'page_link', 0.9, regexp_extract(path, '([^/]+)$', 1) FROM (SELECT page_id,
    regexp_extract(a, '^https?://(?:www\\.)?([^/]+)', 1) AS host, rtrim(regexp_extract(a, '^https?://[^/]+([^?#]*)', 1), '/') AS path,
    CASE WHEN regexp_matches(a, '^https?://([a-z]+\\.)?instagram\\.com/') THEN 'instagram' WHEN regexp_matches(a, '^https?://([a-z]+\\.)?facebook\\.com/') THEN 'facebook'
      WHEN regexp_matches(a, '^https?://([a-z]+\\.)?twitter\\.com/') THEN 'x' END AS kind FROM l) WHERE kind IS NOT NULL
UNION ALL SELECT DISTINCT page_id, 'phone', v, 'json_ld', 0.8, NULL FROM said WHERE key = 'telephone'
UNION ALL SELECT DISTINCT page_id, 'email', regexp_replace(lower(v), '^mailto:', ''), 'json_ld', 0.8, NULL FROM said WHERE key = 'email'
UNION ALL SELECT DISTINCT page_id, kind, regexp_replace(v, '^https://(www[.])?(.*?)/*$', 'https://\\2'), 'json_ld', 0.8, regexp_extract(v, '([^/]+)/*$', 1) FROM (SELECT page_id, v,
    CASE WHEN v LIKE 'https://www.linkedin.com/%' THEN 'linkedin' WHEN v LIKE 'https://youtube.com/%' THEN 'youtube' END AS kind FROM said WHERE key = 'sameAs') WHERE kind IS NOT NULL
UNION ALL SELECT page_id, 'email', v, CASE WHEN edge.page_id IS NULL THEN 'visible_text' ELSE 'edge_text' END, CASE WHEN edge.page_id IS NULL THEN 0.6 ELSE 0.7 END, NULL FROM mails LEFT JOIN edge USING (page_id, v)"""


@query("contacts_on_pages", "E-3 E-5", _over(_CONTACTS, "v_sites", ctes=_LINKED))
def contacts_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.page_contacts(view(spark, sf, "v_sites")).drop("raw")


@query("preferred_page_contacts", "E-3", _over("""
SELECT page_id, kind, first(value ORDER BY confidence DESC, value) AS value, max(confidence) AS confidence, count(DISTINCT value) AS n_values
FROM contacts WHERE kind IS NOT NULL GROUP BY page_id, kind""", "v_sites", ctes=f"{_LINKED}, contacts AS ({_CONTACTS})"))
def preferred_page_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.preferred_profiles(enrichment.page_contacts(view(spark, sf, "v_sites")))


@query("phone_noise_in_documents", "E-4", """
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(\\+?[0-9][0-9 -]{4,}[0-9])', 1)) AS candidate FROM documents),
d AS (SELECT *, regexp_replace(candidate, '[^0-9]', '', 'g') AS n FROM c)
SELECT doc_id, candidate, CASE WHEN regexp_matches(candidate, '^(?:19|20)[0-9]{2}[-/. ]?(?:0[1-9]|1[0-2])[-/. ]?(?:0[1-9]|[12][0-9]|3[01])$') THEN 'date'
  WHEN regexp_matches(candidate, '^[1-9][0-9]{5}$') THEN 'postal_code' WHEN len(n) >= 6 AND n = repeat(n[1], len(n)) THEN 'repeated_digit'
  WHEN len(n) > 13 THEN 'identifier' WHEN len(n) < 6 THEN 'too_short' END AS noise FROM d""")
def phone_noise_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.phone_candidates(table(spark, sf, "documents"))


@query("emails_canonical_form", "E-5", _over("""
SELECT page_id, a AS email, nullif(trim(lower(split_part(regexp_replace(a, '(?i)^mailto:', ''), '?', 1))), '') AS normalized_email,
  regexp_full_match(trim(lower(split_part(regexp_replace(a, '(?i)^mailto:', ''), '?', 1))), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AS is_verified_format
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS a FROM v_sites)""", "v_sites"))
def emails_canonical_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every link value of the pages tried as an address."""
    links = view(spark, sf, "v_sites").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("a"))
    return links.select("page_id", normalize_email(F.col("a")).alias("e")).select("page_id", "e.*")


# --- merging -----------------------------------------------------------------------------------

_RANK = "CASE " + " ".join(
    f"WHEN field = '{f}' AND source = '{s}' THEN {i + 1}" for f, o in V.SOURCE_PRIORITY.items() for i, s in enumerate(o)) + " ELSE 99 END"


@query("merged_fields", "G-1", _over(f"""
SELECT business_id, field, source, value, priority, row_number() OVER (PARTITION BY business_id, field ORDER BY priority, value, source) = 1 AS selected
FROM (SELECT DISTINCT business_id, field, source, value, CAST({_RANK} AS INT) AS priority FROM v_candidates WHERE value IS NOT NULL AND value <> '')""", "v_candidates"))
def merged_fields(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_fields(view(spark, sf, "v_candidates"))


@query("conflicting_fields", "G-2", _over("""
SELECT business_id, field, count(DISTINCT lower(nullif(value, ''))) AS values, CASE count(DISTINCT lower(nullif(value, ''))) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'FOUND' ELSE 'CONFLICTING' END AS state
FROM v_candidates GROUP BY 1, 2""", "v_candidates"))
def conflicting_fields(spark: SparkSession, sf: str) -> DataFrame:
    return merge.field_conflicts(view(spark, sf, "v_candidates"))


def _source_records(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", F.col("id").cast("bigint").alias("seq"), F.lit(None).cast("string").alias("place_id"),
        F.lit(None).cast("string").alias("listing_id"), F.col("social").alias("profile_url"), "normalized_phone",
        "website_domain", "normalized_name", "address")


@query("source_duplicates", "G-3", _over("""
SELECT r.run_id, r.seq, k.seq IS NULL AS is_duplicate FROM recs r LEFT JOIN kept k ON k.run_id = r.run_id AND k.seq = r.seq""", "v_left", ctes="""
recs AS (SELECT run_id, CAST(id AS BIGINT) AS seq, list_filter(['p' || social, 't' || normalized_phone, 'd' || website_domain, 'n' || normalized_name || chr(1) || trim(address)],
  lambda z: z IS NOT NULL) AS p FROM v_left),
greedy AS (SELECT run_id, list_reduce(list({'seq': seq, 'p': p} ORDER BY seq), lambda a, r: CASE WHEN list_has_any(a.held, r.p) THEN a
  ELSE {'held': list_concat(a.held, r.p), 'kept': list_append(a.kept, r.seq)} END, {'held': []::VARCHAR[], 'kept': []::BIGINT[]}).kept AS kept FROM recs GROUP BY run_id),
kept AS (SELECT run_id, unnest(kept) AS seq FROM greedy)"""))
def source_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _source_records(view(spark, sf, "v_left"))
    return dedup.resolve_duplicates(rows, dedup.source_signals()).select("run_id", "seq", "is_duplicate")


_QUALITY = ", ".join(
    f"round(({' + '.join(f'CAST({f} IS NOT NULL AS INT)' for f in fields)}) * 100.0 / {len(fields)}, 2)::DOUBLE AS {area}_quality" for area, fields in merge.QUALITY.items())


@query("quality_scores", "G-4", _over(
    "SELECT *, round((identity_quality + contact_quality + location_quality + website_quality + platform_quality + match_quality) / 6, 6) AS overall_quality FROM q", "v_profiles",
    ctes=f"q AS (SELECT business_id, {_QUALITY}, round(coalesce(match_score, 0.0), 2) AS match_quality FROM v_profiles)"))
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"{a}_quality" for a in [*merge.QUALITY, "match", "overall"]]
    return merge.quality_scores(view(spark, sf, "v_profiles")).select("business_id", *names)


_OBSERVED = _over("""
SELECT 'businesses_discovered' AS metric, count(*) AS value FROM v_listings UNION ALL SELECT 'businesses_normalized', count(*) FROM v_profiles
UNION ALL SELECT 'websites_required', count(*) FROM states WHERE enrichment = 'REQUIRED' UNION ALL SELECT 'websites_skipped', count(*) FROM states WHERE enrichment LIKE 'SKIPPED%'
UNION ALL SELECT 'without_website', count(*) FROM states WHERE enrichment = 'NO_WEBSITE' UNION ALL SELECT 'pages_planned', count(*) FROM crawl
UNION ALL SELECT 'businesses_crawled', count(DISTINCT business_id) FROM crawl UNION ALL SELECT 'matches', count(*) FROM decided_l WHERE decision = 'MATCHED'
UNION ALL SELECT 'unmatched', count(*) FROM decided_l WHERE decision = 'UNMATCHED' UNION ALL SELECT 'ambiguous', count(*) FROM decided_l WHERE decision = 'AMBIGUOUS'
UNION ALL SELECT 'platform_checks', count(*) FROM pres UNION ALL SELECT 'platform_listings_found', count(*) FROM pres WHERE presence = 'PRESENT'
UNION ALL SELECT 'platform_failures', count(*) FROM pres WHERE presence = 'ERROR'
UNION ALL SELECT 'platforms_processed', count(DISTINCT platform_id) FROM pres UNION ALL SELECT 'fields_recovered', CAST(sum(recovered) AS BIGINT) FROM after
UNION ALL SELECT 'website_failures', count(*) FROM after WHERE enrichment = 'FAILED' UNION ALL SELECT 'unmatched_platform', count(*) FROM decided_r WHERE decision = 'UNMATCHED'
UNION ALL SELECT 'export_rows', count(*) FROM (SELECT id FROM decided_l UNION ALL SELECT id FROM decided_r WHERE decision <> 'MATCHED')""", "v_listings", "v_profiles", "v_platforms", "v_platform_results", *_SIDES,
                  ctes=f"{_STATES}, {_CRAWLED}, {_PRESENCE}, {_SCORED}, {_LEFT_DECIDED}, {_RIGHT_DECIDED}")


def observed_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    states, mine, theirs = enrichment_states(spark, sf), cut_lineage(decided(spark, sf)), cut_lineage(decided(spark, sf, "r"))
    return dict(
        sources=view(spark, sf, "v_listings"), businesses=view(spark, sf, "v_profiles"), states=states, plan=enrichment.crawl_plan(states),
        decided=mine, presence=presences(spark, sf), crawled=after_crawl(spark, sf), decided_platform=theirs,
        exported=mine.select("id").unionByName(theirs.filter("decision <> 'MATCHED'").select("id")))


@query("observability_metrics", "G-5", _OBSERVED)
def observability_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return merge.observability(**observed_tables(spark, sf))


@query("metrics_while_writing", "G-5", _OBSERVED)
def metrics_while_writing(spark: SparkSession, sf: str) -> DataFrame:
    _, values = merge.write_observed(observed_tables(spark, sf), f"{ensure_checkpoint_dir(spark)}/observed-{uuid.uuid4().hex}")
    return spark.createDataFrame(sorted(values.items()), "metric string, value long")


# --- exported datasets ------------------------------------------------------------------------

@query("listing_dataset", "G-6", duck.listings("""
SELECT run_id AS "Run ID", google_place_id AS "Google Place ID", name AS "Business Name", normalized_name AS "Normalized Name", city AS "City",
  normalized_phone AS "Phone", website_status AS "Website Status", CAST(NULL AS STRING) AS "Instagram", rating AS "Rating" FROM biz""").replace("normalized_phone AS \"Phone\"", "phone AS \"Phone\""))
def listing_dataset(spark: SparkSession, sf: str) -> DataFrame:
    sheet = merge.listing_sheet(canonical(spark, sf))
    return sheet.select("Run ID", "Google Place ID", "Business Name", "Normalized Name", "City", "Phone", "Website Status", "Instagram", "Rating")


_AS_OF = """latest_check AS (SELECT listing_id, availability_status, checked_at FROM v_snapshots WHERE checked_at <= TIMESTAMP '1998-06-30 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY checked_at DESC, check_id DESC) = 1)"""


def _availability(spark: SparkSession, sf: str) -> DataFrame:
    return platforms.availability_as_of(view(spark, sf, "v_snapshots"), F.to_timestamp(F.lit("1998-06-30 00:00:00")))


@query("platform_dataset", "G-6", _over("""
SELECT run_id AS "Run ID", id AS "Platform Listing ID", normalized_name AS "Normalized Name", category AS "Category", address AS "Address", city AS "City",
  availability_status AS "Availability Status", checked_at AS "Availability Checked At"
FROM v_right LEFT JOIN latest_check ON listing_id = id""", "v_right", "v_snapshots", ctes=_AS_OF))
def platform_dataset(spark: SparkSession, sf: str) -> DataFrame:
    checks = _availability(spark, sf).select(F.col("listing_id").alias("id"), "availability_status", "checked_at")
    return merge.platform_sheet(view(spark, sf, "v_right").join(checks, "id", "left")).select(
        "Run ID", "Platform Listing ID", "Normalized Name", "Category", "Address", "City", "Availability Status", "Availability Checked At")


_MATCHED_SIDES = ", ".join(
    f"CAST({c.format(p=p)} AS STRING) AS \"{side} {title}\"" for p, side in (("l", "left"), ("r", "right")) for title, c in {
        "Name": "{p}.normalized_name", "URL": "NULL", "Phone": "{p}.normalized_phone", "Website": "{p}.website_domain", "Email": "NULL", "Address": "{p}.address",
        "Instagram": "{p}.social", "Rating": "NULL", "Category": "{p}.category"}.items())


@query("matched_dataset", "G-6", _over(f"""
SELECT d.run_id, d.run_id || ':' || d.id || ':' || d.best_id AS match_id, d.best_score AS match_score, d.threshold, d.decision AS match_decision, l.normalized_name AS business_name,
  {_MATCHED_SIDES}, {_LINES} || '; ' || printf('total = %.2f%%', score) AS explanation, pres.presence, availability_status = 'BOOKABLE' AS bookable,
  CAST(NULL AS TIMESTAMP) AS next_available, checked_at
FROM decided_l d JOIN v_left l ON l.id = d.id JOIN v_right r ON r.id = d.best_id JOIN scored s ON s.l_id = d.id AND s.r_id = d.best_id
LEFT JOIN pres ON pres.business_id = d.id AND pres.platform_id = d.best_id LEFT JOIN latest_check ON listing_id = d.best_id WHERE decision = 'MATCHED'""",
                                         *_SIDES, "v_platforms", "v_platform_results", "v_profiles", "v_snapshots", ctes=f"{_SCORED}, {_LEFT_DECIDED}, {_PRESENCE}, {_AS_OF}"))
def matched_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).drop("id", "best_id")


def _matched(spark: SparkSession, sf: str, made: DataFrame | None = None) -> DataFrame:
    left, right = sides(spark, sf)
    pairs = matching.score_pairs(left, right)
    made = made if made is not None else matching.decisions(left, pairs)
    explained = matching.record_pairs(pairs, left, right).select(F.col("l_id").alias("id"), F.col("r_id").alias("best_id"), matching.explain().alias("explanation"))
    return merge.matched_sheet(made, left, right, explained, presences(spark, sf), _availability(spark, sf))


@query("unmatched_datasets", "G-6", _over("""
SELECT 'listing' AS side, l.run_id AS "Run ID", l.normalized_name AS "Normalized Name", best_id AS "Best Candidate", best_score AS "Best Candidate Score", threshold AS "Threshold", reason AS "Unmatched Reason"
FROM unmatched_l d JOIN v_left l USING (id)
UNION ALL SELECT 'platform', r.run_id, r.normalized_name, best_id, best_score, threshold, reason FROM unmatched_r d JOIN v_right r USING (id)""",
                                               *_SIDES, ctes=f"{_SCORED}, {_LEFT_DECIDED}, {_RIGHT_DECIDED}, {_unmatched('l', 'r')}, {_unmatched('r', 'l')}"))
def unmatched_datasets(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(spark, sf)
    shown = ["Run ID", "Normalized Name", *merge.UNMATCHED_TAIL]
    a = merge.unmatched_sheet(unmatched(spark, sf), left, merge.LISTING_SHEET).select(F.lit("listing").alias("side"), *shown)
    b = merge.unmatched_sheet(unmatched(spark, sf, "r"), right, merge.PLATFORM_SHEET).select(F.lit("platform").alias("side"), *shown)
    return a.unionByName(b)


@query("export_checks", "G-7", _over("""
, m AS (SELECT run_id || ':' || id || ':' || best_id AS match_id, CAST(id AS BIGINT) AS n, best_score, threshold FROM decided_l WHERE decision = 'MATCHED'),
broken AS (SELECT match_id, CASE WHEN n % 5 = 1 THEN best_score + 100 ELSE best_score END AS score, CASE WHEN n % 4 = 2 THEN threshold - 1 ELSE threshold END AS threshold FROM m WHERE n % 9 <> 0
  UNION ALL SELECT match_id, best_score, threshold FROM m WHERE n % 3 = 0 AND n % 9 <> 0)
SELECT 'matched_count' AS "check", abs((SELECT count(*) FROM m) - count(*)) AS violations FROM broken
UNION ALL SELECT 'unmatched_count', count(*) FROM decided_l WHERE decision <> 'MATCHED' AND CAST(id AS BIGINT) % 10 = 3
UNION ALL SELECT 'repeated_match_id', count(*) FROM (SELECT match_id FROM broken GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'score_range', count(*) FROM broken WHERE score > 100 OR score < 0
UNION ALL SELECT 'threshold', count(*) FROM broken WHERE threshold <> 80""", *_SIDES, ctes=f"{_SCORED}, {_LEFT_DECIDED}").replace("\n, m AS", ", m AS"))
def export_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The checks over sheets with faults: rows missing and twice, scores out of range, other thresholds."""
    made = cut_lineage(decided(spark, sf))
    n = F.regexp_extract("match_id", ":([0-9]+):", 1).cast("bigint")
    good = cut_lineage(merge.matched_sheet(made, *sides(spark, sf)).withColumn("n", n).filter("n % 9 <> 0"))
    broken = good.withColumns({
        "match_score": F.expr("if(n % 5 = 1, match_score + 100, match_score)"), "threshold": F.expr("if(n % 4 = 2, threshold - 1, threshold)")})
    rest = made.filter("decision <> 'MATCHED' and cast(id as bigint) % 10 <> 3")
    return merge.validate_export(made, broken.unionByName(good.filter("n % 3 = 0")), rest, V.MATCH_THRESHOLD)


@query("filtered_results", "G-8", _over(
    "SELECT business_id, match_score FROM v_profiles WHERE mode IN ('ALWAYS', 'NEVER') AND match_score BETWEEN 10 AND 60 AND phone IS NOT NULL AND instagram IS NOT NULL", "v_profiles"))
def filtered_results(spark: SparkSession, sf: str) -> DataFrame:
    return merge.filter_results(
        view(spark, sf, "v_profiles"), 10, 60, ["phone", "instagram"], mode=["ALWAYS", "NEVER"]).select("business_id", "match_score")


@query("fleet_totals", "G-9", _over("""
SELECT city, category, CAST(grouping(city, category) AS BIGINT) AS level, count(*) AS runs, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'PARTIAL') AS partial,
  count(*) FILTER (status = 'FAILED') AS failed, CAST(sum(saved) AS BIGINT) AS saved FROM counted GROUP BY ROLLUP (city, category)""", "v_runs", "v_outcomes", ctes=_COUNTS))
def fleet_totals(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fleet_totals(_counted(spark, sf))


@query("social_links_on_pages", "E-3", _over("""
SELECT n AS network, count(*) AS links FROM (SELECT CASE WHEN a LIKE '%instagram.com/%' THEN 'instagram' WHEN a LIKE '%facebook.com/%' THEN 'facebook' WHEN a LIKE '%twitter.com/%' THEN 'x' END AS n
FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS a FROM v_sites)) WHERE n IS NOT NULL GROUP BY 1""", "v_sites"))
def social_links_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    links = view(spark, sf, "v_sites").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("a"))
    return links.groupBy(social_network(F.col("a")).alias("network")).agg(F.count(F.lit(1)).alias("links")).filter("network IS NOT NULL")


