"""Blocking misses no pair at the floor; decisions on given scores."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from entitymill import vocabulary as V
from entitymill.operators import matching, platforms, ranking


def businesses(seed, n, offset=0):
    rng = random.Random(seed)
    words = ["royal", "cuts", "salon", "hair", "castle", "spa"]
    roads = ["mg", "rd", "road", "west", "w", "lane", "12", "14", "bandra"]
    out = []
    for i in range(n):
        out.append((
            f"{offset + i:05d}", "r", " ".join(rng.sample(words, rng.randint(1, 4))), rng.choice([None, "p1", "p2", "p3"]),
            rng.choice([None, "d1", "d2"]), rng.choice([None, " ".join(rng.sample(roads, rng.randint(1, 6)))]),
            rng.choice(["c1", "c2", None]), rng.choice(["salon", "hairdresser", "garage", None]), rng.choice([None, "s1"]),
        ))
    return out


SCHEMA = "id string, run_id string, normalized_name string, normalized_phone string, website_domain string, address string, city string, category string, social string"


def brute(left, right):
    """All pairs, scored by the same expressions, no blocks."""
    a, b = matching.profiles(left), matching.profiles(right)
    pairs = a.select([F.col(c).alias(f"l_{c}") for c in a.columns]).join(
        b.select([F.col(c).alias(f"r_{c}") for c in b.columns]), F.col("l_run_id") == F.col("r_run_id"))
    return matching.signal_scores(pairs).withColumn("score", matching.weighted_score())


@pytest.mark.parametrize("floor,hot", [(75, 1_000_000), (65, 3), (55, 1_000_000), (40, 5), (25, 1_000_000)])
def test_blocks_are_complete(spark, floor, hot):
    left, right = (spark.createDataFrame(businesses(s, 120, o), SCHEMA) for s, o in ((1, 0), (2, 500)))
    key = lambda df: sorted((r["l_first_id"], r["r_first_id"], r["score"]) for r in df.collect())
    got = key(matching.score_pairs(left, right, floor, hot_rows=hot))
    assert got == key(brute(left, right).filter(F.col("score") >= floor)) and len(got) > 10


@pytest.mark.parametrize("floors,hot", [(ranking.FLOORS, 1_000_000), ((0.5, 0.25), 4), ((), 1_000_000), ((0.9,), 3)])
def test_best_candidates_are_those_of_all_pairs(spark, floors, hot):
    left, right = (spark.createDataFrame(businesses(s, n, o), SCHEMA) for s, n, o in ((3, 150, 0), (4, 90, 500)))
    # copies, a run of its own, one without a run, one that is like nothing
    more = [("90001", "lonely", "royal cuts", *[None] * 6), ("90002", None, "royal cuts", *[None] * 6), ("90003", "r", None, *[None] * 6)]
    left = left.unionByName(spark.createDataFrame(more, SCHEMA)).unionByName(left.filter("id < '00005'").withColumn("id", F.concat(F.lit("8"), "id")))
    ids = lambda df: df.select("id", F.sha2(F.to_json(F.struct(*matching.COMPARED), {"ignoreNullFields": "false"}), 256).alias("pid"))
    want = {r["id"]: (r["score"], r["rid"]) for r in brute(left, right).join(ids(left), F.col("pid") == F.col("l_pid")).groupBy("id").agg(
        F.max("score").alias("score"), F.min_by("r_first_id", F.struct(-F.col("score"), "r_first_id")).alias("rid")).collect()}
    got = {r["id"]: (r["best_score"], r["best_id"]) for r in ranking.best_candidates(left, right, floors=floors, hot_rows=hot).collect()}
    assert {k: v for k, v in got.items() if v[1] is not None} == want
    assert set(got) == {r["id"] for r in left.collect()} and got["90001"] == got["90002"] == (None, None)


def test_a_best_candidate_of_21_is_found(spark):
    left = spark.createDataFrame([("l", "r", "royal cuts", None, None, None, None, None, None)], SCHEMA)
    right = spark.createDataFrame([
        ("x", "r", "quiet spa", None, None, "12 mg road", "c", "salon", "s"), ("y", "r", "royal cuts", None, None, None, "c", None, None)], SCHEMA)
    assert tuple(ranking.best_candidates(left, right).first())[2:] == ("y", 20.0)
    near = spark.createDataFrame([("l", "r", "zzzz", None, None, "12 mg road bandra west fort", None, "salon", None)], SCHEMA)
    far = spark.createDataFrame([(f"a{i}", "r", "zzzy", None, None, "1 fort lane", None, None, None) for i in range(5)] + [
        ("x", "r", "yyyy", None, None, "12 mg road bandra north", None, "salon", None)], SCHEMA)
    decided = matching.decisions(near, matching.score_pairs(near, far))
    assert (decided.first()["best_id"], decided.first()["reason"]) == (None, "NO_CANDIDATE")
    out = matching.with_best_candidates(decided, ranking.best_candidates(near, far)).first()
    assert (out["best_id"], out["reason"], out["best_score"]) == ("x", "BELOW_THRESHOLD", 17.5)


def _near(l, r):
    same = lambda c: l[c] is not None and l[c] == r[c]
    meaning = lambda x: V.CATEGORY_SYNONYMS.get(x, x)
    return same("normalized_phone") or same("website_domain") or (same("city") and (
        l["normalized_name"][:4] == r["normalized_name"][:4] or l["category"] is not None and meaning(l["category"]) == meaning(r["category"])))


@pytest.mark.parametrize("hot", [1_000_000, 4])
def test_reports_hold_the_pairs_of_their_blocks_below_the_floor_too(spark, hot):
    left, right = (spark.createDataFrame(businesses(s, n, o), SCHEMA) for s, n, o in ((3, 60, 0), (4, 40, 500)))
    pairs = lambda df: {(r["l_id"], r["r_id"]) for r in matching.record_pairs(df, left, right).select("l_id", "r_id").collect()}
    at_floor = pairs(matching.score_pairs(left, right, 55, hot_rows=hot))
    near = {(l["id"], r["id"]) for l in left.collect() for r in right.collect() if _near(l, r)}
    assert near - at_floor and pairs(matching.score_pairs(left, right, 55, hot_rows=hot, reports=True)) == at_floor | near


def test_reports_decide_with_the_best_pair_below_the_margin(spark):
    left = spark.createDataFrame([("l", "r", "royal cuts", "p1", "d", None, "c", "salon", None), ("m", "r", "royal cuts", "p3", "e", None, "k", "salon", None)], SCHEMA)
    right = spark.createDataFrame([("x", "r", "quiet spa", "p2", "d", None, "c", "salon", None), ("y", "r", "loud spa", None, "d", None, "z", None, None)], SCHEMA)
    made = matching.decisions(left, matching.score_pairs(left, right, 55, reports=True))
    got = {r["id"]: r for r in made.collect()}
    assert (got["l"]["best_id"], got["l"]["decision"], got["l"]["reason"]) == ("x", "UNMATCHED", "BELOW_THRESHOLD") and 30 < got["l"]["best_score"] < 55
    assert 20 < got["l"]["second_score"] < 30 and (got["m"]["best_id"], got["m"]["reason"]) == (None, "NO_CANDIDATE")
    again = {r["id"]: r["reason"] for r in matching.rematch(made, 60, "second").collect()}
    assert again == {"l": "BELOW_THRESHOLD", "m": "NO_CANDIDATE"}


def test_a_floor_without_blocks_is_refused(spark):
    left = spark.createDataFrame(businesses(1, 3), SCHEMA)
    with pytest.raises(ValueError):
        matching.score_pairs(left, left, floor=20)


def test_thresholds_below_what_was_scored_are_refused(spark):
    left = spark.createDataFrame(businesses(1, 3), SCHEMA)
    scored = matching.score_pairs(left, left, floor=75)
    with pytest.raises(ValueError):
        matching.decisions(left, scored, threshold=70)
    decided = matching.decisions(left, scored)
    with pytest.raises(ValueError):
        matching.rematch(decided, 60, "second")
    assert matching.rematch(decided, 95, "second").count() == 3


def test_low_thresholds_find_their_pairs(spark):
    one = ("r", "royal cuts", "p", "d1", None, "c", "salon", "s")
    left = spark.createDataFrame([("l", *one)], SCHEMA)
    right = spark.createDataFrame([("x", "r", "royal cuts", "p", "d2", None, "c", "salon", "s")], SCHEMA)
    out = matching.decisions(left, matching.score_pairs(left, right, 55), threshold=60).first()
    assert (out["best_score"], out["decision"], out["reason"]) == (60.0, "MATCHED", None)
    again = matching.rematch(matching.decisions(left, matching.score_pairs(left, right, 55), threshold=80), 60, "second").first()
    assert (again["decision"], again["reason"]) == ("MATCHED", None)


def test_golden_score(spark):
    parts = {"phone": 1.0, "domain": 1.0, "name": 0.94, "address": 0.86, "city": 1.0, "category": 0.8, "social": 0.6}
    df = spark.range(1).select(*[F.lit(v).alias(f"{k}_score") for k, v in parts.items()]).withColumn("score", matching.weighted_score())
    assert df.first()["score"] == pytest.approx(93.0)
    lines = df.select(matching.explain().alias("e")).first()["e"]
    assert "name: 94.00% x 20 = 18.80" in lines and lines.endswith("total = 93.00%")


def test_fixed_lines_are_formatted_once(spark):
    values = [0.0, 1.0, 0.8, 0.5, 0.005, 0.12345, 1 / 3, 0.994999, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        *[F.col("v").alias(f"{s}_score") for s in V.MATCH_WEIGHTS], (F.col("v") * 100).alias("score"))
    lines = [F.format_string(f"{s}: %.2f%% x {w:g} = %.2f", F.col(f"{s}_score") * 100, F.col(f"{s}_score") * float(w)) for s, w in V.MATCH_WEIGHTS.items()]
    plain = F.concat_ws("; ", *lines, F.format_string("total = %.2f%%", F.col("score")))
    out = df.select(matching.explain().alias("e"), plain.alias("p"))
    assert all(r["e"] == r["p"] for r in out.collect())
    plan = df.select(matching.explain())._jdf.queryExecution().optimizedPlan().toString()
    assert "phone: 100.00% x 25 = 25.00" in plan and "category: 80.00% x 5 = 4.00" in plan


@pytest.mark.parametrize("best,second,expected", [
    (95.0, 0.0, "MATCHED"), (80.0, 0.0, "MATCHED"), (79.0, 0.0, "UNMATCHED"), (85.0, 84.0, "AMBIGUOUS"), (85.0, 80.0, "MATCHED"), (None, None, "UNMATCHED"),
])
def test_decision(spark, best, second, expected):
    df = spark.createDataFrame([(best, second)], "best_score double, second_score double")
    assert df.select(matching.decide(F.lit(V.MATCH_THRESHOLD))).first()[0] == expected


def test_copies_tie_and_are_compared_once(spark):
    one = ("a", "r", "royal cuts", "p", "d", "12 mg road", "c", "salon", None)
    left = spark.createDataFrame([one[:0] + (f"l{i}",) + one[1:] for i in range(40)], SCHEMA)
    right = spark.createDataFrame([(f"r{i}",) + one[1:] for i in range(2)], SCHEMA)
    scored = matching.score_pairs(left, right)
    assert scored.count() == 1 and matching.record_pairs(scored, left, right).select("l_id", "r_id").distinct().count() == 80
    out = matching.decisions(left, scored, hot_rows=5).collect()
    assert len(out) == 40 and {(r["decision"], r["best_id"]) for r in out} == {("AMBIGUOUS", "r0")}


def test_one_listing_is_matched_once(spark):
    rows = [("a", "r", "x", 90.0, "MATCHED"), ("b", "r", "x", 95.0, "MATCHED"), ("c", "r", "y", 85.0, "MATCHED"), ("d", "r", "x", 60.0, "UNMATCHED")]
    df = spark.createDataFrame(rows, "id string, run_id string, best_id string, best_score double, decision string")
    got = {r["id"]: r["decision"] for r in matching.resolve_conflicts(df).collect()}
    assert got == {"a": "CONFLICT", "b": "MATCHED", "c": "MATCHED", "d": "UNMATCHED"}


@pytest.mark.parametrize("a,b,relation", [
    ("Salon", "salon", "EXACT"), ("salon", "hairdresser", "SYNONYM"), ("car dealer", "car repair", "CONFLICTING"),
    ("beauty", "spa", "PARENT_CHILD_COMPATIBLE"), ("nail salon", "spa", "RELATED"), ("x", "y", "UNKNOWN"),
])
def test_category_relation(spark, a, b, relation):
    tree = spark.createDataFrame([("spa", "Beauty"), ("nail salon", "beauty")], "category string, parent string")
    df = matching.with_parents(spark.createDataFrame([(a, b)], "a string, b string"), tree, ("a", "b"))
    assert df.select(matching.category_relation(*map(F.col, ("a", "b", "a_parent", "b_parent")))).first()[0] == relation


def test_category_chain_of_any_depth(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("x", "c149"), ("top", None)]
    tree = spark.createDataFrame(chain, "id string, parent_id string")
    counts = spark.createDataFrame([(f"c{i}", 1) for i in range(151)] + [("x", 10), ("lost", 5)], "id string, n long")
    total = {r["id"]: r["total"] for r in platforms.roll_up(tree, counts).collect()}
    assert total["c0"] == 1 and total["c148"] == 149 and total["c149"] == 160 and total["c150"] == 161 and total["top"] == 0 and "lost" not in total
    with pytest.raises(ValueError):
        platforms.roll_up(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"), counts)


def test_metrics_observed_while_writing(spark, tmp_path):
    from entitymill.operators import merge

    plan = spark.range(1000).selectExpr("id", "cast(id % 4 as int) as position").repartition(7)
    presence = spark.createDataFrame([(1, "PRESENT"), (1, "ERROR"), (2, "PRESENT"), (None, None)], "platform_id long, presence string")
    empty = spark.createDataFrame([], "recovered int, enrichment string")
    written, values = merge.write_observed({"plan": plan, "presence": presence, "crawled": empty, "other": plan}, f"{tmp_path}/out")
    assert values == {
        "pages_planned": 1000, "businesses_crawled": 250, "platform_checks": 4, "platform_listings_found": 2, "platform_failures": 1,
        "platforms_processed": 2, "fields_recovered": 0, "website_failures": 0}
    assert {n: df.count() for n, df in written.items()} == {"plan": 1000, "presence": 4, "crawled": 0, "other": 1000}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        merge.write_observed({"plan": plan}, f"{tmp_path}/out")
    assert merge.write_observed({}, f"{tmp_path}/none") == ({}, {})
