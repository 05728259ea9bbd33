"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so: at the first sentence or line end
after ``least`` characters. Chunks are deduplicated to identifiers verified by
their bytes; a text's recipe is its ordered list of identifiers. Only distinct
chunks move once; texts are then compared by their recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

LEAST, MOST = 512, 8192


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text's chunks in order; joined they are the text. None for an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[.!?\n][ \n])|.{{1,{most}}}"), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit(2**bits - 1))


def _clashes(docs: DataFrame, cut: Column, bits: int) -> DataFrame | None:
    """(hash, chunk, rank) of the chunks whose hash another chunk has too, or None if every hash stands for one chunk."""
    distinct = docs.select(F.explode(cut).alias("chunk")).select(_hash(F.col("chunk"), bits).alias("hash"), "chunk").distinct()
    shared = cut_lineage(distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    if shared.isEmpty():
        return None
    other = distinct.join(shared, "hash")
    smaller = other.select("hash", F.col("chunk").alias("less"))
    return other.join(smaller, "hash").filter("less <= chunk").groupBy("hash", "chunk").agg(F.count("*").alias("rank"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST, bits: int = 64) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_sha256, recipe, n (rows that hold it).

    ``recipe`` has (hash, rank) of each chunk, the rank telling apart chunks
    that share a hash: two recipes are equal only if the chunks are. A null text
    counts as empty. ``bits`` shortens the hash, for tests.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cut = chunks(body, least, most)
    hashes = F.transform(cut, lambda c: _hash(c, bits))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), hashes.alias("hashes"))
    rows = rows.groupBy("doc_id", "text_sha256", "hashes").agg(F.count("*").alias("n"))
    named = _clashes(docs.select(body.alias(text)), cut, bits)
    if named is None:
        return rows.select("doc_id", "text_sha256", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(1).cast("long").alias("rank"))).alias("recipe"), "n")
    spots = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), F.posexplode(cut).alias("pos", "chunk"))
    spots = spots.withColumn("hash", _hash(F.col("chunk"), bits)).join(named.filter("rank > 1"), ["hash", "chunk"])
    ranks = spots.groupBy("doc_id", "text_sha256").agg(F.map_from_entries(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    a, b = rows.alias("a"), ranks.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256")), "left")
    recipe = F.transform(F.col("hashes"), lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.col("ranks")[i], F.lit(1).cast("long")).alias("rank")))
    return joined.select("a.doc_id", "a.text_sha256", recipe.alias("recipe"), "n")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **cut: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest doc_id stays; of rows equal in id
    and text, one. Null ids are smaller than any other. Groups of any size are
    summed before the shuffle and joined by recipe.
    """
    rows = cut_lineage(recipes(docs, doc_id, text, **cut))
    # cut, so that the join below deals out both sides itself and can split a recipe with very many rows
    classes = cut_lineage(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    return (
        rows.join(classes, "recipe")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        .select(
            "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256", F.size("recipe").alias("n_chunks"), "n",
        )
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in all their columns, whatever their names; of rows equal in id and text, one."""
    stay = exact_duplicates(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "n")
    whole = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("own"))
    joined = whole.join(stay, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")))
    return joined.filter("n = 1").unionByName(joined.filter("n > 1").dropDuplicates(["id", "sha"])).select("row.*")
