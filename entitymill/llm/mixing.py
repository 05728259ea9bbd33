"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Each source has a schedule of weights over training time. Its integral, scaled
to the source's target, says how many words of it are due by any time; inverted
at the words that come before a document it gives the document's position. The
mix is the documents range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at the knots of training time, by rank of the source, repeating: early, steady, late.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, rank): sources by code point, null last, ranks from zero.

    The order is dealt out by ranges; only the counts of the ranges meet.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = cut_lineage(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("_at", F.row_number().over(inside)).join(offsets, "_range").select("source", "source_size", (F.col("_before") + F.col("_at") - 1).alias("rank"))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with weight and target: ``share`` times all words by weight, at most ``most`` times a source's own.

    What exceeds a source's most is shared out again by weight until no source
    exceeds it. A round sums up the open sources, of which the driver sees three numbers.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # every source below its cap at this level gets level * weight, all others their cap
        capped, open_weight, n = table.agg(
            F.sum(F.when(F.col("cap") <= level * F.col("weight"), F.col("cap"))), F.sum(F.when(F.col("cap") > level * F.col("weight"), F.col("weight"))),
            F.count_if(F.col("cap") > level * F.col("weight")),
        ).first()
        if not n:
            break
        higher = max(level, (share * words - (capped or 0.0)) / open_weight)
        if higher <= level:
            break
        level = higher
    return table.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def _time_of(due: Column, knots: Column) -> Column:
    """When ``due`` (0 to 1, a share of the whole demand) is reached under weights linear between ``knots`` of (t, w, area)."""
    total = F.element_at(knots, -1)["area"]
    area = due * total
    at = F.greatest(F.lit(1), F.least(F.size(knots) - 1, F.size(F.filter(knots, lambda k: k["area"] <= area))))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    rest, width = F.greatest(F.lit(0.0), area - a["area"]), b["t"] - a["t"]
    slope = (b["w"] - a["w"]) / width
    root = F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * rest))
    return F.least(b["t"], a["t"] + F.when(rest == 0, 0.0).otherwise(2 * rest / (a["w"] + root)))


def _knots(schedule: tuple[tuple[float, float], ...]) -> Column:
    area, out = 0.0, []
    for i, (t, w) in enumerate(schedule):
        area += (t - schedule[i - 1][0]) * (w + schedule[i - 1][1]) / 2 if i else 0.0
        out.append(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(area).alias("area")))
    return F.array(*out)


def sized_documents(docs: DataFrame, key: list[Column], source: str = "source", text: str = "text") -> DataFrame:
    """The columns ``key``, source and size (words; null text: none) of every row, cut from its lineage."""
    return cut_lineage(docs.select(*key, F.col(source).alias("source"), word_count(F.col(text)).alias("size")))


def mix(
    sized: DataFrame, key: list[str], share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
) -> DataFrame:
    """``sized`` with source_size, target, taken, passes (an array of (words, position in training)).

    A source's documents lie in a fixed hash order and are taken from its start
    until the target is met, again from the start when a pass ends; the last
    document of a source is taken in part. Rows equal in ``key`` are taken one
    after the other, the same at every run. Documents without words are taken
    zero times. Each source is cut into about sqrt(rows) buckets: one window
    runs inside a bucket, one over a source's bucket sums, so a source with a
    third of all rows is no larger a task than others.
    """
    shares = cut_lineage(targets(ranked_sources(sized), share, most, weights))
    buckets = max(1, math.isqrt(sized.count()))
    order = F.xxhash64(*key, F.col("size"))
    dealt = sized.withColumn("_hash", order).withColumn("_bucket", F.pmod(F.shiftright("_hash", 8), F.lit(buckets)))
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")).alias("a")
    starts = starts.join(shares.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target", "b.rank")
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", *key).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    placed = placed.join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._bucket") == F.col("s._bucket")))
    placed = placed.select("d.*", "s.source_size", "s.target", "s.rank", (F.col("_start") + F.col("_inside")).alias("_at"))
    rounds = F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))
    goal = F.round("target").cast("long")
    knots = F.element_at(F.array(*map(_knots, schedules)), (F.col("rank") % len(schedules) + 1).cast("int"))

    def one_pass(k: Column) -> Column:
        begin = F.col("_at") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin))
        return F.struct(words.alias("words"), _time_of(begin / F.greatest(F.lit(1.0), F.col("target")), knots).alias("position"))

    passes = F.filter(F.transform(rounds, one_pass), lambda p: p["words"] > 0)
    out = placed.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return out.withColumn("taken", taken).select(*sized.columns, "source_size", "target", "taken", "passes")


def in_training_order(mixed: DataFrame, key: list[str]) -> DataFrame:
    """One row per document and pass, range-sorted by position: the mix as it is read."""
    rows = mixed.select(*[c for c in mixed.columns if c != "passes"], F.posexplode("passes").alias("pass", "_p"))
    return rows.select("*", F.col("_p.words").alias("words"), F.col("_p.position").alias("position")).drop("_p").orderBy("position", *key, "pass")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix of ``docs`` in training order, in their own columns: a document read twice is two rows, one taken in part is cut after its words."""
    key = [F.col(doc_id).alias("_doc"), F.xxhash64(doc_id, source, text).alias("_text_hash")]
    rows = mix(sized_documents(docs, key, source, text), ["_doc", "_text_hash"], **how)
    classes = rows.groupBy("_doc", "_text_hash").agg(
        F.flatten(F.collect_list("passes")).alias("_passes"), F.first("size").alias("_size"), F.count("*").alias("_rows")).filter(F.size("_passes") > 0)
    # the documents' own columns stay in a struct, so their names clash with none used here
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(doc_id, source, text).alias("_own"))
    joined = whole.join(classes, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_text_hash")))
    # rows equal in id, source and text are one class with the passes of all
    once = joined.filter("_rows = 1").unionByName(joined.filter("_rows > 1").dropDuplicates(["_doc", "_text_hash"]))
    read = once.withColumn("_p", F.explode("_passes"))
    body = F.col(f"row.`{text}`")
    cut = F.when(F.col("_p.words") < F.col("_size"), first_words(body, F.col("_p.words"))).otherwise(body)
    placed = read.select(F.struct(*[(cut if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("row"), F.col("_p.position").alias("_position"), F.col("_text_hash").alias("_tie"))
    return placed.orderBy("_position", "_tie").select("row.*")
