"""Event rates per key in event time: tumbling, sliding and session windows with a watermark.

A window is given out once, when the watermark (the latest time seen less the
delay) has passed its end; windows it has not reached yet are withheld. Rows
that arrive for a window already given out are dropped by Spark; ``unseen``
counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def _rates(events: DataFrame, span: Column, key: str, value: str) -> DataFrame:
    counted = events.groupBy(key, span.alias("span")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return counted.select(key, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "events", "total")


def rates(
    events: DataFrame, size: str, slide: str | None = None, key: str = "run_id", time: str = "ts", value: str = "value", delay: str | None = None,
) -> DataFrame:
    """(key, window_start, window_end, events, total) per window of ``size``, one every ``slide``; for a stream or a table.

    A row is summed before the shuffle, so a busy key costs one row per task and
    window. Rows without a time are in no window. A stream needs a ``delay``.
    """
    known = events.withWatermark(time, delay) if delay else events
    return _rates(known.filter(F.col(time).isNotNull()), F.window(time, size, slide) if slide else F.window(time, size), key, value)


def sessions(events: DataFrame, gap: str, key: str = "run_id", time: str = "ts", value: str = "value", delay: str | None = None) -> DataFrame:
    """The same per session: rows of a key that follow each other within ``gap``."""
    known = events.withWatermark(time, delay) if delay else events
    return _rates(known.filter(F.col(time).isNotNull()), F.session_window(time, gap), key, value)


def start(counted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Windows that close, appended to ``path`` once each; started again it continues."""
    return counted.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(arrived: DataFrame, given_out: DataFrame, until: Column, size: str, key: str = "run_id", time: str = "ts", value: str = "value") -> DataFrame:
    """(key, window_start, window_end, late) of tumbling windows that ended by ``until`` and had more rows than were given out."""
    whole = rates(arrived, size, key=key, time=time, value=value).filter(F.col("window_end") <= until)
    seen = given_out.select(key, "window_start", F.col("events").alias("_seen"))
    met = whole.join(seen, [key, "window_start"], "left").withColumn("late", F.col("events") - F.coalesce("_seen", F.lit(0)))
    return met.filter("late > 0").select(key, "window_start", "window_end", "late")
