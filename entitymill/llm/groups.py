"""Links inside groups of candidates: every pair of a group is either compared or already joined through others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, release
from .components import components

#: Rounds in which members meet one member of their group, before all pairs still open are compared.
ROUNDS = 3
#: Members of a group that one task holds against as many others.
BLOCK = 256


def _all_pairs(met: DataFrame, block: int, possible: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(u, v), u > v: each pair of a group whose ends are in different components; large groups are cut into blocks, each met by each.

    ``possible`` is a condition on the columns of both ends, met as x and y.
    """
    n_blocks = F.ceil(F.col("n") / block)
    placed = met.withColumn("_own", F.pmod(F.xxhash64("node"), n_blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    facts = [c for c in met.columns if c not in ("key", "node", "component")]
    side = placed.select(F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "key", "node", "component", "_own", *facts)
    apart = F.expr("x.component <> y.component and x._own = lo and y._own = hi and (lo < hi or x.node > y.node)")
    pairs = side.alias("x").join(side.alias("y"), ["key", "lo", "hi"]).filter(apart if possible is None else apart & possible("x", "y"))
    return pairs.select(F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v")).distinct()


def _ends(members: DataFrame, i: int) -> DataFrame:
    """(key, end, end_component): one member of every group, another one in every round; a node is the end of all its groups or of few."""
    return members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "component")).alias("e")).select(
        "key", F.col("e.node").alias("end"), F.col("e.component").alias("end_component"))


def links_within(
    met: DataFrame, near: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, block: int = BLOCK, rest: Callable[[DataFrame], DataFrame] | None = None,
    facts: DataFrame | None = None, possible: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """(u, v): of the pairs that share a group those ``near`` keeps, or enough of them to have the same components.

    ``met``: key, node (long), each once. First each member of a group meets one
    other, which joins a family of copies in linear size; this is repeated while
    it closes groups. What is left are the pairs of a group with ends in
    different components; all of them are compared, or, if there are more of
    them than members, only those of groups of up to ``block`` // 2 members, and
    ``rest`` finds the links of larger groups from their members (key, node,
    component). Where all are compared, ``possible`` rules pairs out where they
    are formed, by the ``facts`` (node, ...) of both ends.
    """
    groups = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = cut_lineage(met.join(groups.drop("n"), "key").withColumn("component", F.col("node")))
    open_ = cut_lineage(open_.join(_ends(open_, 0), "key"))
    found, members = None, open_.count()
    before = members
    for i in range(rounds):
        asked = open_.filter("node <> end and component <> end_component")
        new = cut_lineage(near(asked.select(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("v")).distinct()))
        found = new if found is None else found.unionByName(new)
        roots = components(found).withColumnRenamed("component", "root")
        now = cut_lineage(open_.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("component")))
        parts = now.groupBy("key", "component").agg(F.count("*").alias("m"))
        # a group in one component has nothing left to compare
        left = parts.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("same"), F.count("*").alias("parts")).filter("parts > 1")
        open_ = cut_lineage(now.join(left.join(_ends(now, i + 1), "key").select("key", "n", "same", "end", "end_component"), "key"))
        release(met.sparkSession)
        own_pairs = F.when(F.col("node") == F.col("end"), (F.col("n").cast("double") * F.col("n") - F.col("same")) / 2)
        now_open, pairs = open_.agg(F.count("*"), F.coalesce(F.sum(own_pairs), F.lit(0.0))).first()
        if pairs <= members:
            rest = None
            break
        if 10 * now_open > 9 * before:  # another round would cost as much and join as little
            break
        before = now_open
    if rest is not None:
        # a group decides by its own size, so that few large ones do not send the members of all others to ``rest``
        small = F.col("n") <= block // 2
        found = found.unionByName(rest(open_.filter(~small)))
        open_ = open_.filter(small)
    if facts is not None:
        open_ = open_.join(facts, "node")
    return found.unionByName(near(_all_pairs(open_, block, possible)))
