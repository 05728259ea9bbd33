"""Chunked windows and hot-key joins give what the plain forms give."""

from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

from entitymill.operators import scale


def rows(spark, seed=1, n=400):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i * 3, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(n)]
    return spark.createDataFrame(data, "run_id string, seq bigint, status string, x int")


def test_running_sums(spark):
    df = rows(spark)
    w = Window.partitionBy("run_id").orderBy("seq")
    for inclusive in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        plain = df.withColumn("t", F.coalesce(F.sum("x").over(frame), F.lit(0)))
        chunked = scale.running_sums(df, "run_id", "seq", {"t": F.col("x")}, inclusive, chunk=16)
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, chunked.select(plain.columns).collect()), key=repr)


def test_previous_value(spark):
    df = rows(spark, 2)
    plain = df.withColumn("p", F.lag("status").over(Window.partitionBy("run_id").orderBy("seq")))
    chunked = scale.previous_value(df, "run_id", "seq", "status", "p", chunk=16)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, chunked.select(plain.columns).collect()), key=repr)


def test_no_chunk_of_a_busy_run_is_large(spark):
    """Half of the rows in one run, ids far apart, and a cluster with one outlier."""
    data = [("hot" if i % 2 else f"k{i % 40}", i * 10_000) for i in range(2000)] + [("tight", i) for i in range(300)] + [("tight", 2**60)]
    df = spark.createDataFrame(data, "run_id string, seq bigint").withColumn("x", F.lit(1))
    sizes = scale.chunked(df, "run_id", "seq", 64).groupBy("run_id", "_chunk").agg(F.count("*").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 64
    per_run = {r["run_id"]: r["c"] for r in sizes.groupBy("run_id").agg(F.count("*").alias("c")).collect()}
    assert per_run["hot"] <= 40 and per_run["k0"] == 1
    plain = df.withColumn("t", F.sum("x").over(Window.partitionBy("run_id").orderBy("seq")))
    mine = scale.running_sums(df, "run_id", "seq", {"t": F.col("x")}, chunk=64).select(plain.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.collect()))


def test_attach_per_key_splits_hot_keys(spark):
    df = rows(spark, 3).withColumnRenamed("run_id", "key")
    per_key = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m")).filter("key <> 'k3'")
    expected = sorted(map(tuple, df.join(per_key.drop("n"), "key").collect()), key=repr)
    for hot in (1, 30, 10_000):
        joined = scale.attach_per_key(df, per_key, "key", "n", df.count(), hot)
        assert sorted(map(tuple, joined.select("key", "seq", "status", "x", "m").collect()), key=repr) == expected


def test_first_per_key_limits_before_the_shuffle(spark):
    df = scale.first_per_key(rows(spark), ["run_id"], [F.col("seq")])
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
