"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, release


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _larger_first(both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them."""
    lows = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(lows, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _larger_first(rest.unionByName(lows.withColumnRenamed("m", "v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest node reachable.

    Links to itself and links with a null end are no links. A round halves the
    depth of every tree of links; all sums are combined before their shuffle,
    so a node with very many links is as cheap as many nodes with few. Each
    round is cut by a reliable checkpoint; no link leaves the executors.
    """
    now = cut_lineage(_larger_first(edges.filter("u is not null and v is not null")))
    state = None
    while True:
        n, xor = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, xor) == state:
            break
        state = (n, xor)
        now = cut_lineage(_small_star(_large_star(now)))
    release(edges.sparkSession)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
