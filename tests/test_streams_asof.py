"""Streams with state and windows, as-of joins and platform lists, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from entitymill.operators import dedup, platforms
from entitymill.streaming import first_wins, windows

T0 = dt.datetime(2024, 1, 1)
EVENTS = "run_id string, ts timestamp, value long"


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def run(spark, folder, counted, parts):
    """Each part as a file of its own and a start of its own."""
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        windows.start(counted, f"{folder}/out", f"{folder}/_stream").awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out")


def events_in(spark, folder):
    spark.createDataFrame([], EVENTS).write.parquet(f"{folder}/in")
    return spark.readStream.schema(EVENTS).parquet(f"{folder}/in")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder = str(tmp_path)
    counted = windows.rates(events_in(spark, folder), "10 minutes", delay="5 minutes")
    parts = [
        [("a", minutes(m), 1) for m in (0, 1, 12, 19)] + [("b", minutes(3), 5), ("a", None, 9)],
        [("a", minutes(40), 1)],  # closes what ended by 35
        [("a", minutes(2), 100), ("a", minutes(38), 1), ("b", minutes(41), 7)],  # 2 is late, 38 is not
        [("a", minutes(90), 1)],
    ]
    out = {(r["run_id"], r["window_start"]): (r["events"], r["total"]) for r in run(spark, folder, counted, parts).collect()}
    assert out == {("a", minutes(0)): (2, 2), ("a", minutes(10)): (2, 2), ("b", minutes(0)): (1, 5), ("a", minutes(30)): (1, 1), ("a", minutes(40)): (1, 1), ("b", minutes(40)): (1, 7)}
    arrived = spark.createDataFrame([r for p in parts for r in p], EVENTS)
    late = windows.unseen(arrived, spark.read.schema(counted.schema).parquet(f"{folder}/out"), F.lit(minutes(85)), "10 minutes").collect()
    assert [(r["run_id"], r["window_start"], r["late"]) for r in late] == [("a", minutes(0), 1)]


def test_sliding_windows_and_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), minutes(rng.randrange(3000)), rng.randrange(9)) for _ in range(400)]
    rows.sort(key=lambda r: r[1])
    until = rows[-1][1] - dt.timedelta(minutes=30)
    table = spark.createDataFrame(rows, EVENTS)
    plain = lambda df: sorted(map(tuple, df.filter(F.col("window_end") <= F.lit(until)).collect()), key=repr)
    for name, of in (("sliding", lambda e, d: windows.rates(e, "60 minutes", "20 minutes", delay=d)), ("sessions", lambda e, d: windows.sessions(e, "7 minutes", delay=d))):
        folder = f"{tmp_path}/{name}"
        got = run(spark, folder, of(events_in(spark, folder), "30 minutes"), [rows[:100], rows[100:250], rows[250:]])
        assert plain(got) == plain(of(table, None)) and got.filter(F.col("window_end") > F.lit(until)).count() == 0
    assert windows.sessions(table, "7 minutes").agg(F.sum("events")).first()[0] == len(rows)


LISTING = "run_id string, seq long, google_place_id string, normalized_name string, city string, phone string, normalized_phone string, website_domain string, postal_code string, address string"


def listings(seed, n):
    """Two thirds in one run, many that share names, phones and places."""
    rng = random.Random(seed)
    pick = lambda *v: rng.choice([*v, None])
    return [(
        rng.choice(["busy", "busy", "b", "c"]), i, pick("p1", "p2", "", f"p{i}", f"q{i}"), pick("royal cuts", "spa", f"n{i % 40}"), pick("pune", "noida"),
        pick("1", f"{i % 50}"), pick("1", f"{i % 30}"), pick("d.com", f"d{i % 45}.com"), pick("400001", f"{400000 + i % 60}"), pick("1 mg road", f"{i % 70} lane")) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 3])
def test_first_wins_on_a_stream_is_that_of_the_table(spark, tmp_path, parts):
    rows = spark.createDataFrame(listings(9, 400), LISTING)
    folder, n = str(tmp_path), 400 // parts + 1
    for k in range(parts):
        rows.filter(f"seq div {n} = {k}").coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        first_wins.start(spark, stream, f"{folder}/out", f"{folder}/_stream").awaitTermination()
    first_wins.start(spark, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/_stream").awaitTermination()
    got = {(r["scope"], r["seq"]): (r["dup_of"], r["signal"]) for r in first_wins.duplicates(spark, f"{folder}/out").collect()}
    want = {(r["run_id"], r["seq"]): (r["dup_of"], r["signal"]) for r in dedup.resolve_duplicates(rows).filter("is_duplicate").collect()}
    assert got == want and len(want) > 50


def test_a_busy_run_has_a_state_per_key(spark):
    keys = dedup.key_rows(spark.createDataFrame(listings(9, 400), LISTING).filter("run_id = 'busy'"), dedup.listing_signals())
    assert keys.select("key").distinct().count() > 250  # no state holds more than a number


CHECKS = "listing_id string, check_id long, availability_status string, checked_at timestamp"


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_every_row_gets_the_check_before_its_own_time(spark, chunk):
    rng = random.Random(1)
    checks = [(rng.choice(["busy", "busy", "a", "b", None]), i, rng.choice(["BOOKABLE", "NO_SLOTS", None]), rng.choice([minutes(rng.randrange(200)), None] if i % 20 == 0 else [minutes(rng.randrange(200))])) for i in range(300)]
    asked = [(i, rng.choice(["busy", "busy", "a", "b", "new", None]), minutes(rng.randrange(-5, 220)) if i % 15 else None, "x") for i in range(200)] + [(0, "busy", minutes(50), "x")] * 2
    df = spark.createDataFrame(asked, "n int, listing_id string, at timestamp, check_id string").withColumnRenamed("check_id", "_check")
    got = platforms.availability_at(df, spark.createDataFrame(checks, CHECKS), chunk=chunk).collect()
    want = []
    for n, listing, at, _ in asked:
        known = [(t, i, s) for name, i, s, t in checks if None not in (name, t, at) and name == listing and t <= at]
        want.append((n, listing, at, max(known, key=lambda k: k[:2]) if known else (None, None, None)))
    assert sorted(((r["n"], r["listing_id"], r["at"], (r["checked_at"], r["check_id"], r["availability_status"])) for r in got), key=repr) == sorted(want, key=repr)


def test_platform_lists_have_no_limit(spark):
    n = 200_000
    ids = spark.range(n).select(F.col("id").cast("string").alias("platform_id"), F.lit(True).alias("active"), F.lit(True).alias("discovery_supported"))
    requests = spark.createDataFrame([("a", "ALL"), ("b", "AUTO"), ("c", "ALL")], "category string, mode string")
    none = spark.createDataFrame([("b", "7", True)], "category string, platform_id string, enabled boolean")
    out = platforms.select_platforms(requests, none, none.drop("enabled"), ids)
    assert {(r["category"], r["n"], r["d"]) for r in out.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("platform_id").alias("d")).collect()} == {("a", n, n), ("b", 1, 1), ("c", n, n)}
    assert platforms.select_platforms(requests, none, none.drop("enabled"), ids.limit(0)).count() == 0


@pytest.mark.parametrize("block,part", [(1000, 100_000), (3, 4)])
def test_presence_of_many_platforms(spark, block, part):
    rng = random.Random(3)
    run_platforms = [(r, f"{p}") for r, n in (("x", 25), ("y", 3)) for p in range(n)]
    firms = [(f"f{i}", rng.choice(["x", "x", "y", "z"])) for i in range(30)]
    results = [(f"f{rng.randrange(30)}", f"{rng.randrange(25)}", rng.choice(["found", "none", "error"]), float(rng.randrange(100))) for _ in range(200)]
    frames = [spark.createDataFrame(rows, s) for rows, s in (
        (firms, "business_id string, run_id string"), (run_platforms + run_platforms[:4], "run_id string, platform_id string"), (results, "business_id string, platform_id string, outcome string, score double"))]
    got = {(r["business_id"], r["platform_id"]): r["presence"] for r in platforms.presence(*frames, block_ids=block, part_rows=part).collect()}
    rank = lambda o, s: 0 if o == "found" and s >= 50 else 1 if o == "found" else 2 if o == "error" else 3
    best = {}
    for f, p, o, s in results:
        best[f, p] = min(best.get((f, p), 9), rank(o, s))
    want = {(f, p): platforms.PRESENCE[best.get((f, p), 1)] for f, r in firms for q, p in run_platforms if q == r}
    assert got == want
