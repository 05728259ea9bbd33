"""Whole runs: goldens of batch, stream, crash and resume; storage round trips."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from entitymill import schemas
from entitymill.operators import accounting, browse, validation
from entitymill.sources import evidence, publish, raw
from entitymill.streaming import live

AT = dt.datetime(2024, 1, 1)
RAW = schemas.RAW_LISTING + ", run_city string"


def listing(seq, run="r", **kw):
    base = dict.fromkeys([c.split()[0] for c in schemas.RAW_LISTING.split(",")])
    return base | {"run_id": run, "seq": seq, "scraped_at": AT, "run_city": "Mumbai"} | kw


def frame(spark, rows):
    names = [c.split()[0] for c in RAW.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RAW)


def batch_of(limit, extra=30):
    """Valid rows; each 7th is followed by a repeat, each 10th by a nameless row."""
    out, i = [], 1
    while i <= limit + extra:
        out.append(dict(place_id=f"P{i}", name=f"Shop {i:05d}", phone=f"+9198765{i:05d}", address=f"Street {i}, Mumbai, Maharashtra 400001"))
        if i % 7 == 0:
            out.append(dict(place_id=f"P{i - 1}", name=f"Shop {i - 1:05d}", phone=f"+9198765{i - 1:05d}"))
        if i % 10 == 0:
            out.append(dict(place_id=f"X{i}", name=""))
        i += 1
    return [listing(n, **r) for n, r in enumerate(out)]


def run(spark, rows, limit):
    cleaned = validation.clean_listings(frame(spark, rows))
    ok = cleaned.filter("coalesce(status, '') <> 'EXTRACTION_FAILED'")
    fates = accounting.outcomes_of(cleaned, validation.canonicalize(validation.split_valid(ok)[0]))
    runs = spark.createDataFrame([("r", limit)], "run_id string, requested_limit int")
    counters = accounting.run_counters(accounting.apply_limit(fates, runs, chunk=64)).join(runs, "run_id").withColumns(
        {"cancelled": F.lit(False), "error_message": F.lit(None).cast("string")})
    r = accounting.final_status(counters).first()
    return r["attempted"], r["saved"], r["duplicates"], r["failed"], r["final_status"]


@pytest.mark.parametrize("limit,golden", [
    (10, (11, 10, 1, 0, "COMPLETED")), (50, (61, 50, 7, 4, "COMPLETED")),
    (100, (123, 100, 14, 9, "COMPLETED")), (500, (620, 500, 71, 49, "COMPLETED")),
])
def test_scale_goldens(spark, limit, golden):
    assert run(spark, batch_of(limit), limit) == golden


def test_partial_run(spark):
    rows = [listing(i, place_id=f"p{i}", name=f"Shop {i}") for i in range(3)] + [listing(3, name=" ")]
    assert run(spark, rows, 4) == (4, 3, 0, 1, "PARTIAL")


def test_failed_extraction_counts_as_failed(spark):
    rows = [listing(0, name="Failed Extraction", status="EXTRACTION_FAILED")]
    assert run(spark, rows, 4) == (1, 0, 0, 1, "FAILED")


def test_optional_fields_never_reject(spark):
    row = listing(0, name="Royal Cuts", phone="INVALID", website="not-a-url-###", latitude=999.0, longitude=-999.0, rating=5.8, review_count="-10")
    ok, bad = validation.split_valid(validation.clean_listings(frame(spark, [row])))
    b = validation.canonicalize(ok).first()
    assert bad.count() == 0
    assert [b[c] for c in ("normalized_phone", "website_domain", "latitude", "longitude", "rating", "review_count")] == [None] * 6
    assert (b["website"], b["website_status"], b["city"]) == ("not-a-url-###", "INVALID", "Mumbai")


def test_provenance_rows(spark):
    row = listing(0, place_id="ChIJ1", name="Blue Door Pvt Ltd", category="Bakery", address="12 Hill Road Bandra, Mumbai, Maharashtra 400050",
                  phone="+91 98200 12345", website="https://blue.example/?utm_source=x", rating=4.6, review_count="35", latitude=19.055, longitude=72.835,
                  profile_url="https://m.example/1")
    trail = validation.provenance(validation.canonicalize(validation.clean_listings(frame(spark, [row])))).collect()
    got = {r["field_name"]: r for r in trail}
    assert len(trail) == 16 and len({r["id"] for r in trail}) == 16
    assert got["coordinates"]["field_value"] == "19.055,72.835" and got["rating"]["field_value"] == "4.6"
    assert got["normalized_phone"]["raw_fragment"] == "+91 98200 12345" and got["google_place_id"]["confidence"] == 1.0
    assert got["street"]["validator_rule"] == "thoroughfare_or_premise_token"


def stream_dir(spark, path, rows):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def counts(spark, path):
    return {r["outcome"]: r["count"] for r in live.read_live(spark, path, "outcomes").groupBy("outcome").count().collect()}


def test_stream_equals_batch(spark, tmp_path):
    rows = batch_of(40)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    limits = spark.createDataFrame([("r", 40)], "run_id string, requested_limit int")
    for part in (rows[:15], rows[15:40], rows[40:]):
        stream_dir(spark, source, part)
        stream = spark.readStream.schema(RAW).parquet(source)
        live.start_listings(stream, out, str(tmp_path / "ckpt"), limits).awaitTermination()
    got = counts(spark, out)
    attempted, saved, duplicates, failed, _ = run(spark, rows, 40)
    assert (sum(got.values()), got["saved"], got["duplicate"], got["failed"]) == (attempted, saved, duplicates, failed)
    kept = live.read_live(spark, out, "businesses")
    assert kept.count() == 40 and kept.select("google_place_id").distinct().count() == 40
    assert live.read_live(spark, out, "source_records").count() == attempted


def test_stream_survives_a_crash_after_publishing(spark, tmp_path):
    """The batch that fails after writing is repeated and leaves the same rows."""
    rows = batch_of(12)
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    limits = spark.createDataFrame([("r", 12)], "run_id string, requested_limit int")
    stream_dir(spark, source, rows)
    stream = spark.readStream.schema(RAW).parquet(source)

    def crash(batch_id):
        raise RuntimeError("executor lost")

    with pytest.raises(Exception):
        live.start_listings(stream, out, ckpt, limits, crash).awaitTermination()
    before = live.read_live(spark, out, "businesses").count()
    live.start_listings(stream, out, ckpt, limits).awaitTermination()
    live.start_listings(stream, out, ckpt, limits).awaitTermination()
    after = live.read_live(spark, out, "businesses")
    assert before == after.count() == 12 and after.select("id").distinct().count() == 12


def test_publish_twice_adds_nothing(spark, tmp_path):
    cleaned = validation.clean_listings(frame(spark, batch_of(5)))
    businesses = validation.canonicalize(validation.split_valid(cleaned)[0])
    path = str(tmp_path)
    for _ in range(2):
        publish.publish(businesses, validation.provenance(businesses), path)
    assert publish.published(spark, path, "businesses").count() == businesses.count()
    trail = publish.published(spark, path, "provenance")
    assert validation.orphans(trail, businesses, "business_id").count() == 0


def test_publish_keeps_the_first_of_a_place(spark, tmp_path):
    first = validation.canonicalize(validation.split_valid(validation.clean_listings(frame(spark, batch_of(4))))[0])
    moved = first.withColumns({"seq": F.col("seq") + 1000, "id": F.concat("id", F.lit("x"))})
    path = str(tmp_path)
    publish.publish(first, validation.provenance(first), path)
    publish.publish(moved, validation.provenance(moved), path)
    stored = publish.published(spark, path, "businesses")
    placed = first.filter("google_place_id is not null and trim(google_place_id) <> ''").count()
    assert placed > 0 and stored.count() == 2 * first.count() - placed
    assert validation.orphans(publish.published(spark, path, "provenance"), stored, "business_id").count() == 0


def test_records_of_unknown_runs_are_kept(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream_dir(spark, source, batch_of(5))
    limits = spark.createDataFrame([("other", 1)], "run_id string, requested_limit int")
    live.start_listings(spark.readStream.schema(RAW).parquet(source), out, str(tmp_path / "ckpt"), limits).awaitTermination()
    assert live.read_live(spark, out, "source_records").count() == len(batch_of(5)) and live.read_live(spark, out, "businesses").count() > 0


def test_limits_out_of_range_are_refused(spark):
    runs = spark.createDataFrame([(f"r{i:03d}", AT, "COMPLETED", 1, 0) for i in range(150)], "run_id string, created_at timestamp, status string, saved int, failed int")
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            browse.list_runs(runs, limit, offset)
    assert browse.dashboard(runs, 130).first()["total_runs"] == 130


def test_evidence_round_trip(spark, tmp_path):
    listings = frame(spark, batch_of(6, 0))
    businesses = validation.canonicalize(validation.split_valid(validation.clean_listings(listings))[0])
    sources = raw.ingest_raw(listings)
    runs = spark.createDataFrame(
        [("r", "COMPLETED", AT, "Mumbai", "Salon", 6, 6, 6), ("q", "FAILED", AT, "Pune", "Spa", 9, 0, 0)],
        "run_id string, status string, completed_at timestamp, city string, category string, requested_limit int, discovered int, saved int")
    path = str(tmp_path / "evidence")
    assert evidence.export_evidence(runs, businesses, validation.provenance(businesses), sources, path)
    header, biz, src = evidence.load_evidence(spark, path)
    h = header.first()
    assert (h["city"], h["businesses_count"], h["source_records_count"]) == ("Mumbai", businesses.count(), sources.count())
    assert biz.count() == businesses.count() and src.count() == sources.count()
    assert sorted(biz.select("id", "name", "rating").collect(), key=str) == sorted(businesses.select("id", "name", "rating").collect(), key=str)
    nested = tmp_path / "doc.json"
    nested.write_text(json.dumps({"city": "Mumbai", "businesses": [{"id": "b", "name": "x"}], "source_records": [{"id": "s"}, {"id": "t"}]}))
    header, biz, src = evidence.load_document(spark, str(nested))
    assert (header.first()["city"], biz.first()["name"], src.count()) == ("Mumbai", "x", 2)
    assert not evidence.export_evidence(runs.filter("status = 'FAILED'"), businesses, validation.provenance(businesses), sources, path)


def test_unreadable_lines_are_kept(spark, tmp_path):
    file = tmp_path / "in.jsonl"
    file.write_text(json.dumps({"run_id": "r", "seq": 1, "name": "a"}) + "\n{broken\n")
    df = raw.ingest_raw(raw.read_listings(spark, str(file)).withColumn("run_id", F.lit("r")))
    failed = raw.failed_extractions(df).collect()
    assert df.count() == 2 and [r["error"] for r in failed] == ["unreadable record"]


def test_older_batches_get_defaults(spark, tmp_path):
    a, b = str(tmp_path / "t" / "v=1"), str(tmp_path / "t" / "v=2")
    spark.range(2).write.parquet(a)
    spark.range(1).withColumn("duplicates", F.lit(7)).write.parquet(b)
    df = raw.read_evolved(spark, [a, b], {"duplicates": 0, "added": "x"})
    assert sorted((r["duplicates"], r["added"]) for r in df.collect()) == [(0, "x"), (0, "x"), (7, "x")]


def test_raw_layer_is_partitioned_by_run(spark, tmp_path):
    raw.write_raw(raw.ingest_raw(frame(spark, batch_of(3, 0))), str(tmp_path / "raw"))
    assert os.path.isdir(tmp_path / "raw" / "run_id=r")
    plan = spark.read.parquet(str(tmp_path / "raw")).filter("run_id = 'r'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_payload_fields(spark):
    doc = json.dumps({"query": "q", "card_lines": ["a", "b"], "extraction_strategies": {"phone": "x"}})
    df = spark.createDataFrame([(doc,), ("{no json",)], "raw_payload string")
    r = raw.payload_fields(df).collect()
    assert (r[0]["card_lines"], r[0]["extraction_strategies"]["phone"], r[1]["query"]) == (["a", "b"], "x", None)


def test_search_and_pages(spark):
    rows = [(f"b{i:02d}", f"shop {i}", "Spa" if i % 2 else "Salon", "9" if i == 3 else None, "Mumbai", None, None, float(i % 4)) for i in range(15)]
    df = spark.createDataFrame(rows, "id string, normalized_name string, name string, phone string, city string, address string, category string, rating double")
    df = df.withColumns({"created_at": F.lit(AT), "updated_at": F.lit(AT), "review_count": F.lit(1)})
    assert browse.page_meta(df, 1, 5).first().asDict() == {"page": 1, "page_size": 5, "total": 15, "total_pages": 3}
    assert browse.page_meta(df, 1, 5, "SPA").first()["total"] == 7
    assert browse.search(df, " % ").count() == 15 and browse.search(df, "").count() == 15
    assert browse.page_meta(df, 1, 5, "zzz").first()["total_pages"] == 1
    assert [r["id"] for r in browse.page(df, 2, 4, None, "nonsense", "up").collect()] == ["b10", "b09", "b08", "b07"]
    assert browse.page(df, 0, 5, None, "rating", "asc").first()["rating"] == 0.0
    assert "TakeOrderedAndProject" in browse.page(df, 1, 5)._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_cleaning_plan(spark, sf_dir):
    from entitymill.plans.cleaning_queries import canonical

    plan = canonical(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_lookups_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["source_records_of_run"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint" in plan


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from entitymill import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake())


def test_deep_pages_equal_a_full_sort(spark):
    import random

    rng = random.Random(5)
    rows = [(f"id{i:05d}", None if i % 7 == 0 else "Pune" if i % 3 == 0 else rng.choice("abcdefgh") * (i % 4), None if i % 11 == 0 else rng.choice([0.5, 1.0, float("nan"), i / 7]),
             None if i % 50 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(900))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, city string, rating double, created_at timestamp").repartition(5).cache()
    for column in ("city", "rating", "created_at"):
        for way in ("asc", "desc"):
            order = [F.col(column), F.col("id")] if way == "asc" else [F.desc(column), F.desc("id")]
            every = [r["id"] for r in df.orderBy(*order).collect()]
            for number in (40, 75) if column == "city" else (40,):
                got = [r["id"] for r in browse.page(df, number, 40, None, column, way, direct=60).collect()]
                assert got == every[(number - 1) * 40:number * 40], (column, way, number)
    assert browse.page(df, 76, 40, direct=60).count() == 0
    assert browse.page(df, 9, 40, direct=60, sort_by="city", sort_order="asc").count() == 40
    same = spark.createDataFrame([("x", "c")] * 500, "id string, city string")
    assert browse.window_of(same, ["city", "id"], False, 400, 50, direct=20).count() == 50
    assert browse.window_of(same.limit(0), ["city", "id"], False, 400, 50, direct=20).count() == 0


def test_deep_pages_read_one_range(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id * 7 % 100000 as seq").write.parquet(f"{tmp_path}/t")
    page = browse.window_of(spark.read.parquet(f"{tmp_path}/t"), ["seq"], False, 90_000, 5, direct=500)
    assert [r["seq"] for r in page.collect()] == [90_000, 90_001, 90_002, 90_003, 90_004]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq" in plan and "LessThanOrEqual(seq" in plan and "Exchange rangepartitioning" not in plan
