"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from entitymill.session import cut_lineage

# Rows of one key that share a chunk; a chunk is the unit one task sorts.
CHUNK = 1 << 18

# A key counts as hot from this many rows on; see attach_per_key.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 50_000


def chunked(df: DataFrame, key: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``_chunk``: ranges of ``order`` within a key that hold at most about ``chunk`` rows.

    A key of up to ``chunk`` rows is one range. Larger ranges are cut into even
    parts of what they span, counted, and cut again while they hold too much,
    so neither sparse nor clustered numbers leave a busy key in one task. Too
    large ranges number at most rows / chunk, so they are broadcast with a proven bound.
    """
    rows = cut_lineage(df).withColumn("_chunk", F.lit(0).cast("bigint"))
    least = max(chunk, rows.count() // MAX_HOT_KEYS + 1)
    while True:
        cells = rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        large = cut_lineage(cells.filter(F.col(key).isNotNull() & (F.col("_n") > least) & (F.col("_lo") < F.col("_hi"))))
        if large.isEmpty():
            return rows
        cut = large.select(key, "_chunk", "_lo", F.expr(f"(_hi - _lo) div ceil(_n / {least}) + 1").alias("_width"))
        start = F.expr(f"_lo + ((`{order}` - _lo) div _width) * _width")
        rows = rows.join(F.broadcast(cut), [key, "_chunk"], "left").withColumn("_chunk", F.coalesce(start, F.col("_chunk"))).drop("_lo", "_width")


def running_sums(
    df: DataFrame, key: str, order: str, sums: dict[str, Column], inclusive: bool = True,
    chunk: int = CHUNK, per_key: DataFrame | None = None,
) -> DataFrame:
    """Running totals of ``sums`` per ``key`` in ``order``, in two passes.

    ``order`` is a whole number, unique within its key. Ranges of about
    ``chunk`` rows bound what a task sorts, however many rows one key has: pass
    one totals the ranges, pass two adds each range's start to a window inside it.
    Columns of ``per_key`` (one row per key; null for other keys) ride along
    with the starts, so they never cause a shuffle of rows by the bare key.
    """
    ranged = chunked(df, key, order, chunk)
    totals = ranged.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        key, "_chunk",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums],
    )
    if per_key is not None:
        starts = starts.join(per_key, key, "left")
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = ranged.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    )
    joined = local.join(starts, [key, "_chunk"])
    out = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_{n}") for n in sums})
    return out.drop("_chunk", *[f"_l_{n}" for n in sums], *[f"_{n}" for n in sums])


def previous_value(df: DataFrame, key: str, order: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Value of the row before, per ``key`` in ``order``; chunked like running_sums."""
    ranged = chunked(df, key, order, chunk)
    lasts = ranged.groupBy(key, "_chunk").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(key).orderBy("_chunk")
    carried = lasts.select(key, "_chunk", F.lag("_last").over(across).alias("_carried"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    local = ranged.withColumns({
        "_lag": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1,
    })
    joined = local.join(carried, [key, "_chunk"])
    return joined.withColumn(
        out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))
    ).drop("_chunk", "_lag", "_first", "_carried")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark cuts to one row per key and task before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def attach_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, n: str, total_rows: int, hot_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join (inner or left) of many rows with one row per key, safe for hot keys.

    ``per_key[n]`` says how many of ``rows`` carry the key and ``total_rows``
    how many there are. At most total_rows / threshold keys can reach the
    threshold, so the hot side is broadcast with a proven bound and their rows
    stay where they are; all other keys are joined by shuffle.
    """
    threshold = max(hot_rows, total_rows // MAX_HOT_KEYS + 1)
    if total_rows < threshold:
        return rows.join(per_key.drop(n), key, how)
    hot = F.broadcast(per_key.filter(F.col(n) >= threshold).drop(n))
    cold = per_key.filter(F.col(n) < threshold).drop(n)
    stays = rows.join(hot, key)
    moves = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return stays.unionByName(moves)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a table arrives in fewer splits than cores.

    One unsplittable file would run all cleaning in one task. Large tables have
    more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
