"""Progress events: counters per run, one run's feed, overlay on the run table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill.operators.accounting import progress_percent, run_counters


def live_counters(outcomes: DataFrame) -> DataFrame:
    """Running counters per run of an outcome stream, for update or complete mode.

    State is five numbers per run and is combined before the shuffle, so one
    busy run costs no more than any other.
    """
    return run_counters(outcomes)


def progress_events(counters: DataFrame, runs: DataFrame, stage: str = "DISCOVERING_GOOGLE") -> DataFrame:
    """Counters as run.progress events, or the terminal event at the limit."""
    joined = counters.join(runs.select("run_id", "requested_limit"), "run_id")
    done = F.col("saved") >= F.col("requested_limit")
    return joined.withColumns({
        "event": F.when(done, F.lit("run.completed")).otherwise(F.lit("run.progress")),
        "status": F.when(done, F.lit("COMPLETED")).otherwise(F.lit("RUNNING")),
        "stage": F.lit(stage),
        "percentage": F.when(done, F.lit(100)).otherwise(progress_percent(F.col("saved"), F.col("requested_limit"))),
    }).drop("requested_limit")


def events_for(events: DataFrame, run_id: str) -> DataFrame:
    return events.filter(F.col("run_id") == run_id)


def reconcile(runs: DataFrame, events: DataFrame, fields: list[str]) -> DataFrame:
    """The run table with its newest event's fields laid over it.

    The table stays the truth: runs without an event keep their values and
    events of unknown runs are dropped.
    """
    newest = events.groupBy("run_id").agg(
        F.max_by(F.struct(*fields), "seq").alias("_event")
    )
    overlay: dict[str, Column] = {
        f: F.coalesce(F.col(f"_event.{f}"), F.col(f)) if f in runs.columns else F.col(f"_event.{f}") for f in fields
    }
    return runs.join(newest, "run_id", "left").withColumns(overlay).drop("_event")
