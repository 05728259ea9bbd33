"""Duplicate resolution, run accounting, lifecycle and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from entitymill.functions.text import blank_to_null
from entitymill.operators import accounting, browse, dedup, validation
from entitymill.plans import duck
from entitymill.plans.cleaning_queries import canonical, stored
from entitymill.plans.derived import view, with_views
from entitymill.plans.registry import query
from entitymill.session import cut_lineage
from entitymill.sources import raw
from entitymill.sources.evidence import evidence_header


# --- duplicates -----------------------------------------------------------------

@query("unseen_candidates", "DD-1 DD-9", with_views("""
, prior AS (SELECT run_id, profile_url, place_id FROM v_listings WHERE extract('hour' FROM scraped_at) < 6),
u0 AS (SELECT * FROM v_listings l WHERE extract('hour' FROM scraped_at) >= 6 AND NOT EXISTS (SELECT 1 FROM prior p WHERE p.run_id = l.run_id AND p.profile_url = l.profile_url)),
u AS (SELECT * FROM u0 QUALIFY row_number() OVER (PARTITION BY run_id, profile_url ORDER BY seq) = 1),
i AS (SELECT * FROM u WHERE nullif(place_id, '') IS NULL OR NOT EXISTS (SELECT 1 FROM prior p WHERE p.run_id = u.run_id AND p.place_id = u.place_id))
SELECT run_id, seq FROM i QUALIFY nullif(place_id, '') IS NULL OR row_number() OVER (PARTITION BY run_id, place_id ORDER BY seq) = 1""", "v_listings").replace(") \n,", "),"))
def unseen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Morning rows are an earlier batch of the run, the rest are candidates."""
    listings = view(spark, sf, "v_listings")
    early = F.hour("scraped_at") < 6
    prior = raw.ingest_raw(listings.filter(early))
    places, links = browse.known_ids(prior)
    return dedup.drop_seen(
        listings.filter(~early), links.withColumnRenamed("source_url", "profile_url"),
        places.withColumnRenamed("external_id", "place_id"),
    ).select("run_id", "seq")


@query("first_record_per_place", "DD-2 DD-9", duck.listings("""
SELECT run_id, seq, google_place_id FROM biz
QUALIFY nullif(google_place_id, '') IS NULL OR row_number() OVER (PARTITION BY run_id, google_place_id ORDER BY seq) = 1"""))
def first_record_per_place(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_place(canonical(spark, sf)).select("run_id", "seq", "google_place_id")


def _edges_sql(condition: str) -> str:
    return duck.listings(
        f"SELECT b.run_id, b.seq, min(a.seq) AS first_seq FROM biz b JOIN biz a ON a.run_id = b.run_id AND a.seq < b.seq "
        f"AND a.normalized_name = b.normalized_name AND {condition} GROUP BY 1, 2")


_SAME_CITY = "a.city = b.city AND b.city <> ''"
_PHONE = "coalesce(nullif(b.phone, ''), b.normalized_phone)"


def _edges(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    signal = next(s for s in dedup.listing_signals() if s.rank == rank)
    return dedup.signal_edges(canonical(spark, sf), signal)


@query("earlier_same_phone", "DD-3", _edges_sql(f"{_SAME_CITY} AND (a.phone = {_PHONE} OR a.normalized_phone = {_PHONE})"))
def earlier_same_phone(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, 2)


@query("earlier_same_domain", "DD-4", _edges_sql(f"{_SAME_CITY} AND a.website_domain = trim(b.website_domain) AND trim(b.website_domain) <> ''"))
def earlier_same_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, 3)


@query("earlier_same_postal_code", "DD-5", _edges_sql(f"{_SAME_CITY} AND a.postal_code = trim(b.postal_code)"))
def earlier_same_postal_code(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, 4)


@query("earlier_same_address", "DD-6", _edges_sql("a.address = trim(b.address, ' ' || chr(10)) AND trim(b.address) <> ''"))
def earlier_same_address(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, 5)


_NAMES = "CASE w.rank WHEN 1 THEN 'place_id' WHEN 2 THEN 'name_city_phone' WHEN 3 THEN 'name_city_domain' WHEN 4 THEN 'name_city_postal' " \
    "WHEN 5 THEN 'name_address' WHEN 6 THEN 'empty_place_id' END"


@query("resolved_duplicates", "DD-7 DD-8 DD-9", duck.listings(
    f"SELECT r.run_id, r.seq, w.of IS NOT NULL AS is_duplicate, w.of AS dup_of, {_NAMES} AS signal FROM recs r LEFT JOIN why USING (run_id, seq)",
    duck.keys_cte()))
def resolved_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.resolve_duplicates(stored(spark, sf)).select("run_id", "seq", "is_duplicate", "dup_of", "signal")


# --- the whole run -----------------------------------------------------------------

def run_limits(listings: DataFrame) -> DataFrame:
    """Requested limit per run of the derived listings: the day of month times ten."""
    return listings.select("run_id").distinct().withColumn(
        "requested_limit", F.substring("run_id", -2, 2).cast("int") * 10)


def outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "v_listings")
    return accounting.outcomes_of(rows, stored(spark, sf)), run_limits(rows)


_OUTCOME_CTES = """
fate AS MATERIALIZED (SELECT c.run_id, c.seq, CASE WHEN b.seq IS NULL THEN 'failed' WHEN k.seq IS NULL THEN 'duplicate' ELSE 'saved' END AS outcome
  FROM checked c LEFT JOIN biz b USING (run_id, seq) LEFT JOIN kept k USING (run_id, seq)),
lim AS (SELECT DISTINCT run_id, CAST(run_id[-2:] AS INT) * 10 AS requested_limit FROM checked),
cut AS (SELECT * FROM (SELECT f.*, requested_limit, coalesce(sum(CAST(outcome = 'saved' AS INT)) OVER (PARTITION BY f.run_id ORDER BY f.seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fate f JOIN lim USING (run_id)) WHERE before < requested_limit)"""


@query("record_outcomes", "DD-7 RA-1 V-7", duck.listings("SELECT run_id, seq, outcome FROM fate", duck.keys_cte(), _OUTCOME_CTES))
def record_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf)[0].select("run_id", "seq", "outcome")


@query("run_summary", "RA-1 RA-2 RA-4 RA-5 DD-7 V-1 IO-1", duck.listings("""
SELECT run_id, attempted, saved, failed, duplicates, requested_limit,
  CASE WHEN saved >= requested_limit THEN 'COMPLETED' WHEN saved > 0 AND failed > 0 THEN 'PARTIAL' WHEN saved > 0 THEN 'COMPLETED'
    WHEN attempted > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS final_status,
  CAST(least(100, floor(saved / greatest(requested_limit, 1) * 100)) AS INT) AS percentage
FROM (SELECT run_id, requested_limit, count(*) AS attempted, count(*) FILTER (outcome = 'saved') AS saved,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'duplicate') AS duplicates FROM cut GROUP BY 1, 2)""",
                                                                         duck.keys_cte(), _OUTCOME_CTES))
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: raw listings to one accounted row per run."""
    fates, limits = outcomes(spark, sf)
    counters = accounting.run_counters(accounting.apply_limit(fates, limits)).join(limits, "run_id").withColumns({
        "cancelled": F.lit(False), "error_message": F.lit(None).cast("string"), "status": F.lit("RUNNING"),
    })
    done = accounting.progress(accounting.final_status(counters))
    return done.select("run_id", "attempted", "saved", "failed", "duplicates", "requested_limit", "final_status", "percentage")


# --- accounting over single-record outcomes --------------------------------------------

def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the counters of their outcome rows."""
    counters = accounting.run_counters(view(spark, sf, "v_outcomes"))
    names = ["discovered", "attempted", "saved", "failed", "duplicates"]
    return view(spark, sf, "v_runs").join(counters, "run_id", "left").fillna(0, names)


_COUNTS = """counts AS (SELECT run_id, count(*) AS discovered, count(*) AS attempted, count(*) FILTER (outcome = 'saved') AS saved,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'duplicate') AS duplicates FROM v_outcomes GROUP BY 1),
counted AS (SELECT r.*, coalesce(discovered, 0) AS discovered, coalesce(attempted, 0) AS attempted, coalesce(saved, 0) AS saved,
  coalesce(failed, 0) AS failed, coalesce(duplicates, 0) AS duplicates FROM v_runs r LEFT JOIN counts USING (run_id))"""


def _counted_sql(tail: str, *more: str) -> str:
    return with_views("\x00", "v_runs", "v_outcomes").replace(" \x00", ", " + ", ".join([_COUNTS, *more]) + " ") + tail


def _over(tail: str, *views: str, ctes: str = "") -> str:
    return with_views("\x00", *views).replace(" \x00", (", " + ctes if ctes else "") + " ") + tail


@query("counters_per_run", "RA-1", _counted_sql("SELECT * FROM counts"))
def counters_per_run(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.run_counters(view(spark, sf, "v_outcomes"))


@query("attempted_until_limit", "RA-2", _over("""
SELECT run_id, seq, outcome FROM (SELECT o.*, r.requested_limit, coalesce(sum(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) OVER
  (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM v_outcomes o JOIN v_runs r USING (run_id)) WHERE before < requested_limit""", "v_outcomes", "v_runs"))
def attempted_until_limit(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.apply_limit(view(spark, sf, "v_outcomes"), view(spark, sf, "v_runs"))


@query("candidate_budgets", "RA-3", _counted_sql("""
SELECT run_id, greatest(0, requested_limit - saved) AS remaining, CASE WHEN requested_limit > saved
  THEN greatest(3 * (requested_limit - saved), requested_limit - saved + 30) ELSE 0 END AS budget FROM counted"""))
def candidate_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.candidate_budget(_counted(spark, sf)).select("run_id", "remaining", "budget")


@query("candidates_within_budget", "RA-3", _over("""
SELECT run_id, seq FROM (SELECT o.run_id, o.seq, greatest(3 * r.requested_limit, r.requested_limit + 30) AS budget,
  row_number() OVER (PARTITION BY o.run_id ORDER BY o.seq) AS n FROM v_outcomes o JOIN v_runs r USING (run_id)) WHERE n <= budget""",
                                                 "v_outcomes", "v_runs"))
def candidates_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    budgets = accounting.candidate_budget(view(spark, sf, "v_runs").withColumn("saved", F.lit(0)))
    return accounting.within_budget(view(spark, sf, "v_outcomes"), budgets).select("run_id", "seq")


_FINAL = """CASE WHEN status = 'CANCELLED' THEN 'CANCELLED' WHEN coalesce(error_message, '') <> '' AND saved = 0 THEN 'FAILED'
  WHEN saved >= requested_limit THEN 'COMPLETED' WHEN saved > 0 AND failed > 0 THEN 'PARTIAL' WHEN saved > 0 THEN 'COMPLETED'
  WHEN saved = 0 AND discovered > 0 THEN 'FAILED' ELSE 'COMPLETED' END"""


@query("final_run_status", "RA-4", _counted_sql(f"SELECT run_id, {_FINAL} AS final_status FROM counted"))
def final_run_status(spark: SparkSession, sf: str) -> DataFrame:
    runs = _counted(spark, sf).withColumn("cancelled", F.col("status") == "CANCELLED")
    return accounting.final_status(runs).select("run_id", "final_status")


@query("progress_percentages", "RA-5", _counted_sql("""
SELECT run_id, CAST(least(100, floor(saved / greatest(requested_limit, 1) * 100)) AS INT) AS percentage,
  CAST(CASE WHEN status IN ('COMPLETED', 'PARTIAL', 'FAILED', 'CANCELLED') THEN 100 WHEN requested_limit <= 0 THEN 0
    ELSE least(100, floor((saved + failed) / requested_limit * 100 + 0.5)) END AS INT) AS console_percentage FROM counted"""))
def progress_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.progress(_counted(spark, sf)).select("run_id", "percentage", "console_percentage")


@query("progress_after_each_record", "RA-6 ST-3", _over("""
SELECT run_id, seq, CAST(sum(1) OVER w AS BIGINT) AS attempted, CAST(sum(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS saved,
  CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed,
  CAST(sum(CASE WHEN outcome = 'duplicate' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS duplicates,
  CAST(least(100, floor(sum(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) OVER w / greatest(requested_limit, 1) * 100)) AS INT) AS percentage
FROM v_outcomes JOIN v_runs USING (run_id) WINDOW w AS (PARTITION BY run_id ORDER BY seq)""", "v_outcomes", "v_runs"))
def progress_after_each_record(spark: SparkSession, sf: str) -> DataFrame:
    log = accounting.progress_log(view(spark, sf, "v_outcomes"), view(spark, sf, "v_runs"))
    return log.select("run_id", "seq", "attempted", "saved", "failed", "duplicates", "percentage")


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in accounting.V.STATUS_CHANGES)


@query("illegal_status_changes", "RA-7", _over(f"""
SELECT run_id, seq, from_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS from_status FROM v_status_log)
WHERE from_status <> status AND (from_status, status) NOT IN ({_ALLOWED})""", "v_status_log"))
def illegal_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.illegal_transitions(view(spark, sf, "v_status_log")).select("run_id", "seq", "from_status", "status")


@query("current_run_state", "RA-8 RA-11", _over("""
SELECT run_id, arg_max(status, seq) AS status, min(changed_at) FILTER (status = 'RUNNING') AS started_at, arg_max(changed_at, seq) AS updated_at,
  arg_max(status, seq) = 'CANCELLED' AS cancelled FROM v_status_log GROUP BY 1""", "v_status_log"))
def current_run_state(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.current_runs(view(spark, sf, "v_status_log"))


@query("stale_runs_interrupted", "RA-9", _over(f"""
SELECT run_id, 'INTERRUPTED' AS status, '{accounting.V.STALE_MESSAGE}' AS error_message FROM v_runs WHERE status IN ('RUNNING', 'QUEUED')""", "v_runs"))
def stale_runs_interrupted(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.recover_stale(view(spark, sf, "v_runs")).select("run_id", "status", "error_message")


@query("resumed_counters", "RA-10", _over("""
SELECT run_id, count(*) AS discovered, count(*) AS attempted, count(*) FILTER (outcome = 'saved') AS saved,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'duplicate') AS duplicates FROM v_outcomes GROUP BY 1""", "v_outcomes"))
def resumed_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts of every run, split in time, add up to the whole."""
    log = view(spark, sf, "v_outcomes").join(
        view(spark, sf, "v_status_log").select("run_id", "seq", "changed_at"), ["run_id", "seq"])
    first = F.dayofmonth("changed_at") < 15
    return accounting.resume_counters(
        accounting.run_counters(log.filter(first)), accounting.run_counters(log.filter(~first)))


@query("outcomes_before_cancellation", "RA-11", _over("""
SELECT o.run_id, o.seq, o.outcome FROM v_outcomes o LEFT JOIN c USING (run_id) WHERE c.stop IS NULL OR o.seq < c.stop""",
                                                     "v_outcomes", "v_status_log",
                                                     ctes="c AS (SELECT run_id, max(seq) AS stop FROM v_status_log GROUP BY 1 HAVING arg_max(status, seq) = 'CANCELLED')"))
def outcomes_before_cancellation(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.before_cancel(view(spark, sf, "v_outcomes"), view(spark, sf, "v_status_log"))


@query("failure_codes", "RA-12", _over("""
SELECT run_id, CASE WHEN error_message = 'Run was cancelled by user.' THEN 'CANCELLED_BY_USER' WHEN error_message ILIKE '%browser_start_failed%' THEN 'BROWSER_START_FAILED'
  WHEN error_message ILIKE '%navigation_failed%' THEN 'NAVIGATION_FAILED' WHEN error_message ILIKE '%feed_not_found%' THEN 'FEED_NOT_FOUND'
  WHEN error_message IS NOT NULL THEN 'UNKNOWN_ERROR' END AS failure_code FROM v_runs""", "v_runs"))
def failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_runs").select("run_id", accounting.classify_error(F.col("error_message")).alias("failure_code"))


@query("counter_violations", "RA-13", _counted_sql("""
SELECT run_id, discovered, saved, failed, duplicates FROM counted
WHERE discovered <> attempted OR discovered <> saved + duplicates + failed - CASE WHEN coalesce(error_message, '') <> '' THEN 1 ELSE 0 END"""))
def counter_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with an error text whose failed counter lacks that error are reported."""
    return accounting.audit_counts(_counted(spark, sf)).select("run_id", "discovered", "saved", "failed", "duplicates")


@query("permitted_actions", "RA-14", _over("""
SELECT run_id, 'start' AS action, CASE WHEN status IN ('RUNNING', 'QUEUED') THEN 'noop' WHEN status = 'CREATED' THEN 'allowed' ELSE 'refused' END AS verdict FROM v_runs
UNION ALL SELECT run_id, 'resume', CASE WHEN status IN ('RUNNING', 'QUEUED') THEN 'noop' WHEN status IN ('INTERRUPTED', 'FAILED', 'CANCELLED', 'CREATED') THEN 'allowed'
  ELSE 'refused' END FROM v_runs
UNION ALL SELECT run_id, 'cancel', CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN 'refused' ELSE 'allowed' END FROM v_runs""", "v_runs"))
def permitted_actions(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "v_runs")
    parts = [accounting.eligible(runs, a).select("run_id", "action", "verdict") for a in ("start", "resume", "cancel")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- browsing -------------------------------------------------------------------------------

@query("runs_newest_first", "Q-1", _over(
    "SELECT run_id, status, created_at FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 50 OFFSET 20", "v_runs"))
def runs_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_runs(view(spark, sf, "v_runs"), 50, 20).select("run_id", "status", "created_at")


@query("run_count", "Q-2", _over("SELECT count(*) AS total FROM v_runs", "v_runs"))
def run_count(spark: SparkSession, sf: str) -> DataFrame:
    return browse.count_runs(view(spark, sf, "v_runs"))


@query("listing_by_place", "Q-3 Q-9", duck.listings(
    "SELECT seq, name FROM biz WHERE run_id = 'run_2024-01-03' AND google_place_id = 'ChIJ8_1'"))
def listing_by_place(spark: SparkSession, sf: str) -> DataFrame:
    return browse.lookup(canonical(spark, sf), run_id="run_2024-01-03", google_place_id="ChIJ8_1").select("seq", "name")


_HIT = """(normalized_name ILIKE '{t}%' OR phone ILIKE '{t}%' OR city ILIKE '{t}%' OR name ILIKE '%{t}%' OR address ILIKE '%{t}%' OR category ILIKE '%{t}%')"""


@query("search_hits", "Q-4", duck.listings(f"SELECT seq FROM biz WHERE {_HIT.format(t='mum_ai')}"))
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search(stored(spark, sf), "  MUM_ai ").select("seq")


@query("result_page", "Q-4 Q-5 Q-6", duck.listings(f"""
SELECT seq, name, rating FROM (SELECT *, 'biz_' || sha256(run_id || '|' || CAST(seq AS STRING))[1:32] AS id FROM biz) WHERE {_HIT.format(t='house')}
ORDER BY rating DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100"""))
def result_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse.page(stored(spark, sf), 3, 50, "house", "rating", "desc").select("seq", "name", "rating")


@query("result_page_ascending", "Q-5 Q-6", duck.listings("""
SELECT seq, city FROM (SELECT *, 'biz_' || sha256(run_id || '|' || CAST(seq AS STRING))[1:32] AS id FROM biz) ORDER BY city NULLS FIRST, id LIMIT 40"""))
def result_page_ascending(spark: SparkSession, sf: str) -> DataFrame:
    return browse.page(stored(spark, sf), 1, 40, None, "city", "ASC").select("seq", "city")


@query("deep_result_page", "Q-5 Q-6", duck.listings("""
SELECT seq, city, id FROM (SELECT *, 'biz_' || sha256(run_id || '|' || CAST(seq AS STRING))[1:32] AS id FROM biz) ORDER BY city DESC NULLS LAST, id DESC LIMIT 40 OFFSET 3960"""))
def deep_result_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse.page(cut_lineage(stored(spark, sf)), 100, 40, None, "city", "desc", direct=1000).select("seq", "city", "id")


@query("result_page_size", "Q-7", duck.listings(f"""
SELECT CAST(3 AS INT) AS page, CAST(50 AS INT) AS page_size, count(*) AS total, CAST(greatest(ceil(count(*) / 50), 1) AS BIGINT) AS total_pages FROM biz WHERE {_HIT.format(t='house')}"""))
def result_page_size(spark: SparkSession, sf: str) -> DataFrame:
    return browse.page_meta(stored(spark, sf), 3, 50, "house")


@query("business_details", "Q-8", duck.listings("""
SELECT seq, name, CAST(1 + 1 + CAST(coalesce(google_place_id, '') <> '' AS INT) + CAST(coalesce(category, '') <> '' AS INT) + CAST(coalesce(address, '') <> '' AS INT)
  + CAST(coalesce(street, '') <> '' AS INT) + CAST(coalesce(locality, '') <> '' AS INT) + CAST(postal_code IS NOT NULL AS INT) + CAST(state IS NOT NULL AS INT)
  + CAST(coalesce(phone, '') <> '' AS INT) + CAST(normalized_phone IS NOT NULL AS INT) + CAST(coalesce(website, '') <> '' AS INT) + CAST(website_domain IS NOT NULL AS INT)
  + CAST(latitude IS NOT NULL AND longitude IS NOT NULL AS INT) + CAST(rating IS NOT NULL AS INT) + CAST(review_count IS NOT NULL AS INT) AS INT) AS provenance_count FROM biz"""))
def business_details(spark: SparkSession, sf: str) -> DataFrame:
    return browse.details(canonical(spark, sf)).select("seq", "name", "provenance_count")


@query("businesses_per_run", "Q-10", duck.listings("SELECT run_id, count(*) AS n FROM biz GROUP BY 1"))
def businesses_per_run(spark: SparkSession, sf: str) -> DataFrame:
    return browse.count_by_run(canonical(spark, sf))


@query("source_records_of_run", "Q-11", _over(
    "SELECT seq, name AS raw_name FROM v_listings WHERE run_id = 'run_2024-01-05' ORDER BY seq LIMIT 100 OFFSET 10", "v_listings"))
def source_records_of_run(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_sources(raw.ingest_raw(view(spark, sf, "v_listings")), "run_2024-01-05", 100, 10).select("seq", "raw_name")


@query("known_identifiers", "Q-12", _over("""
SELECT DISTINCT run_id, 'place' AS kind, place_id AS value FROM v_listings WHERE place_id <> ''
UNION ALL SELECT DISTINCT run_id, 'link', profile_url FROM v_listings WHERE profile_url <> ''""", "v_listings"))
def known_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    places, links = browse.known_ids(raw.ingest_raw(view(spark, sf, "v_listings")))
    return places.select("run_id", F.lit("place").alias("kind"), F.col("external_id").alias("value")).unionByName(
        links.select("run_id", F.lit("link").alias("kind"), F.col("source_url").alias("value")))


@query("dashboard_totals", "Q-13", _counted_sql("""
SELECT count(*) AS total_runs, count(*) FILTER (status IN ('COMPLETED', 'PARTIAL')) AS completed_runs, CAST(coalesce(sum(saved), 0) AS BIGINT) AS total_saved,
  CAST(coalesce(sum(failed), 0) AS BIGINT) AS total_failed FROM (SELECT * FROM counted ORDER BY created_at DESC, run_id DESC LIMIT 50)"""))
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    return browse.dashboard(_counted(spark, sf))


@query("latest_completed_run", "Q-14", _over(
    "SELECT run_id, completed_at FROM v_runs WHERE status = 'COMPLETED' ORDER BY completed_at DESC, run_id DESC LIMIT 1", "v_runs"))
def latest_completed_run(spark: SparkSession, sf: str) -> DataFrame:
    return browse.latest_completed(view(spark, sf, "v_runs")).select("run_id", "completed_at")


@query("elapsed_times", "Q-15", _over("""
SELECT run_id, CASE WHEN started_at IS NULL THEN 'Pending' WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS elapsed
FROM (SELECT run_id, started_at, date_diff('second', started_at, coalesce(completed_at, TIMESTAMP '2024-03-01 00:00:00')) AS s FROM v_runs)""", "v_runs"))
def elapsed_times(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-03-01 00:00:00"))
    return browse.elapsed(view(spark, sf, "v_runs"), now).select("run_id", "elapsed")


@query("repeated_place_keys", "Q-17", duck.listings(
    "SELECT run_id, google_place_id, count(*) AS n FROM biz WHERE google_place_id <> '' GROUP BY 1, 2 HAVING count(*) > 1"))
def repeated_place_keys(spark: SparkSession, sf: str) -> DataFrame:
    named = canonical(spark, sf).filter(blank_to_null(F.col("google_place_id")).isNotNull())
    return validation.duplicate_keys(named, ["run_id", "google_place_id"])


@query("evidence_header", "IO-5", _counted_sql("""
SELECT r.run_id, r.city, r.category, r.requested_limit, r.status, r.discovered AS records_discovered, r.saved AS records_saved,
  (SELECT count(*) FROM v_outcomes o WHERE o.run_id = r.run_id AND outcome = 'saved') AS businesses_count,
  (SELECT count(*) FROM v_outcomes o WHERE o.run_id = r.run_id) AS source_records_count,
  (SELECT count(*) FROM v_outcomes o WHERE o.run_id = r.run_id AND outcome <> 'saved') AS provenances_count
FROM (SELECT * FROM counted WHERE status = 'COMPLETED' ORDER BY completed_at DESC, run_id DESC LIMIT 1) r"""))
def evidence_of_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_outcomes")
    return evidence_header(
        _counted(spark, sf), rows.filter("outcome = 'saved'"), rows.filter("outcome <> 'saved'"), rows).drop("verified_at")
