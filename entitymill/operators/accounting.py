"""Run counters, limits, lifecycle and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import literal_array
from entitymill.operators.dedup import resolve_duplicates
from entitymill.operators.scale import attach_per_key, previous_value, running_sums
from entitymill.session import cut_lineage

SAVED, DUPLICATE, FAILED = "saved", "duplicate", "failed"


def _is(outcome: str) -> Column:
    return (F.col("outcome") == outcome).cast("bigint")


def outcomes_of(cleaned: DataFrame, businesses: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(run_id, seq, outcome, dup_of, signal) of every raw record.

    ``cleaned`` are all raw records with status and errors, ``businesses`` the
    canonical rows of those that passed.
    """
    resolved = resolve_duplicates(businesses, prior=prior).select("run_id", "seq", "is_duplicate", "dup_of", "signal")
    return cleaned.select("run_id", "seq").join(resolved, ["run_id", "seq"], "left").withColumn(
        "outcome",
        F.when(F.col("is_duplicate").isNull(), F.lit(FAILED))
        .when(F.col("is_duplicate"), F.lit(DUPLICATE)).otherwise(F.lit(SAVED)),
    ).drop("is_duplicate")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """One row per run; the partial counts leave each task already summed."""
    return outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("outcome") == SAVED).alias("saved"),
        F.count_if(F.col("outcome") == FAILED).alias("failed"),
        F.count_if(F.col("outcome") == DUPLICATE).alias("duplicates"),
    )


def apply_limit(outcomes: DataFrame, runs: DataFrame, **kw: int) -> DataFrame:
    """Records attempted before their run reached its accepted limit.

    The record that reaches the limit is the last one; later ones were never
    attempted. Decisions depend on earlier records only, so cutting after
    resolution equals stopping during it. A run that ``runs`` does not have, or
    has without a limit, is attempted to its end.
    """
    limits = runs.select("run_id", "requested_limit")
    seen = running_sums(outcomes, "run_id", "seq", {"_before": _is(SAVED)}, inclusive=False, per_key=limits, **kw)
    return seen.filter(F.col("requested_limit").isNull() | (F.col("_before") < F.col("requested_limit"))).drop(
        "_before", "requested_limit"
    )


def candidate_budget(runs: DataFrame, saved: str = "saved") -> DataFrame:
    """How many candidates a run may look at: max(3 * remaining, remaining + 30)."""
    remaining = F.greatest(F.lit(0), F.col("requested_limit") - F.coalesce(F.col(saved), F.lit(0)))
    return runs.withColumn("remaining", remaining).withColumn(
        "budget",
        F.when(F.col("remaining") > 0, F.greatest(F.col("remaining") * 3, F.col("remaining") + 30)).otherwise(0),
    )


def within_budget(candidates: DataFrame, budgets: DataFrame, **kw: int) -> DataFrame:
    """Candidates of each run up to its budget, in arrival order."""
    allowed = budgets.select("run_id", "budget")
    counted = running_sums(candidates, "run_id", "seq", {"_nth": F.lit(1)}, per_key=allowed, **kw)
    return counted.filter("_nth <= budget").drop("_nth", "budget")


def final_status(counters: DataFrame) -> DataFrame:
    """Add ``final_status``; needs cancelled, error_message and requested_limit."""
    saved, failed = F.col("saved"), F.col("failed")
    return counters.withColumn(
        "final_status",
        F.when(F.coalesce(F.col("cancelled"), F.lit(False)), F.lit("CANCELLED"))
        .when((F.coalesce(F.col("error_message"), F.lit("")) != "") & (saved == 0), F.lit("FAILED"))
        .when(saved >= F.col("requested_limit"), F.lit("COMPLETED"))
        .when((saved > 0) & (failed > 0), F.lit("PARTIAL"))
        .when(saved > 0, F.lit("COMPLETED"))
        .when(F.col("discovered") > 0, F.lit("FAILED"))
        .otherwise(F.lit("COMPLETED")),
    )


def progress_percent(saved: Column, limit: Column) -> Column:
    return F.least(F.lit(100), F.floor(saved / F.greatest(limit, F.lit(1)) * 100)).cast("int")


def progress(counters: DataFrame) -> DataFrame:
    """Stored percentage and the console's, which counts failures and rounds."""
    limit = F.col("requested_limit")
    console = (
        F.when(F.col("status").isin(V.CONSOLE_TERMINAL_STATUSES), F.lit(100))
        .when(limit <= 0, F.lit(0))
        .otherwise(F.least(F.lit(100), F.floor((F.col("saved") + F.col("failed")) / limit * 100 + 0.5)))
    )
    return counters.withColumns({
        "percentage": progress_percent(F.col("saved"), limit), "console_percentage": console.cast("int"),
    })


def progress_log(outcomes: DataFrame, runs: DataFrame, **kw: int) -> DataFrame:
    """Counters after every record, as the progress events carry them."""
    counted = running_sums(
        outcomes, "run_id", "seq",
        {"attempted": F.lit(1), "saved": _is(SAVED), "failed": _is(FAILED), "duplicates": _is(DUPLICATE)},
        per_key=runs.select("run_id", "requested_limit"), **kw,
    )
    return counted.withColumns({
        "discovered": F.col("attempted"),
        "percentage": progress_percent(F.col("saved"), F.col("requested_limit")),
    })


def illegal_transitions(log: DataFrame, **kw: int) -> DataFrame:
    """Status changes the lifecycle does not allow; repeats of a status are fine.

    Unknown statuses are reported too.
    """
    steps = previous_value(log, "run_id", "seq", "status", "from_status", **kw)
    allowed = literal_array([f"{a}>{b}" for a, b in V.STATUS_CHANGES])
    change = F.concat(F.col("from_status"), F.lit(">"), F.col("status"))
    return steps.filter(
        F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status"))
        & ~F.array_contains(allowed, change)
    )


def current_runs(log: DataFrame) -> DataFrame:
    """Latest status and first start per run; whether the latest is a cancellation."""
    return log.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("changed_at"))).alias("started_at"),
        F.max_by("changed_at", "seq").alias("updated_at"),
        (F.max_by("status", "seq") == "CANCELLED").alias("cancelled"),
    )


def recover_stale(runs: DataFrame) -> DataFrame:
    """Runs left active by a stopped process, marked INTERRUPTED."""
    return runs.filter(F.col("status").isin(V.ACTIVE_STATUSES)).withColumns({
        "status": F.lit("INTERRUPTED"), "error_message": F.lit(V.STALE_MESSAGE),
    })


def resume_counters(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counters carried forward by those of the resumed part."""
    names = ["discovered", "attempted", "saved", "failed", "duplicates"]
    old = stored.select("run_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    # an older row without an attempted count is taken to have attempted what it discovered
    old = old.withColumn("attempted", F.when(F.col("attempted") == 0, F.col("discovered")).otherwise(F.col("attempted")))
    return old.unionByName(new.select("run_id", *names)).groupBy("run_id").agg(
        *[F.sum(n).alias(n) for n in names]
    )


def before_cancel(outcomes: DataFrame, log: DataFrame) -> DataFrame:
    """Outcomes recorded before their run's latest cancellation took effect."""
    stops = log.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("stop")
    ).filter("status = 'CANCELLED'").select("run_id", "stop")
    sizes = cut_lineage(outcomes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    met = attach_per_key(outcomes, stops.join(sizes, "run_id"), "run_id", "_n", total, how="left")
    return met.filter("stop IS NULL OR seq < stop").drop("stop")


def classify_error(message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(message == "Run was cancelled by user.", F.lit("CANCELLED_BY_USER"))
        .when(text.contains("browser_start_failed"), F.lit("BROWSER_START_FAILED"))
        .when(text.contains("navigation_failed"), F.lit("NAVIGATION_FAILED"))
        .when(text.contains("feed_not_found"), F.lit("FEED_NOT_FOUND"))
        .when(message.isNotNull(), F.lit("UNKNOWN_ERROR"))
    )


def audit_counts(counters: DataFrame) -> DataFrame:
    """Runs whose counters do not add up; run-level errors count as failed only."""
    run_errors = F.when(F.coalesce(F.col("error_message"), F.lit("")) != "", 1).otherwise(0)
    return counters.filter(
        (F.col("discovered") != F.col("attempted"))
        | (F.col("discovered") != F.col("saved") + F.col("duplicates") + F.col("failed") - run_errors)
    )


def eligible(runs: DataFrame, action: str) -> DataFrame:
    """What ``start``, ``resume`` or ``cancel`` would do to each run."""
    status = F.col("status")
    active = status.isin(V.ACTIVE_STATUSES)
    rules = {
        "start": F.when(active, F.lit("noop")).when(status == "CREATED", F.lit("allowed")),
        "resume": F.when(active, F.lit("noop")).when(status.isin(V.RESUMABLE_STATUSES), F.lit("allowed")),
        "cancel": F.when(~status.isin(V.UNCANCELLABLE_STATUSES), F.lit("allowed")),
    }
    return runs.withColumns({
        "action": F.lit(action), "verdict": F.coalesce(rules[action], F.lit("refused")),
    })
