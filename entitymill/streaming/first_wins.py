"""First record wins, on a stream, with one small state per signal key.

A record becomes its key rows. The state of a key is one number, the earliest
accepted record that holds it; a run's state is as spread as its keys are. Key
rows pass the state and leave with what it knows; the batch is then settled by
the same rounds as a table, and what it accepted is written as files that the
stream itself reads with its next batch, which brings the states up to date.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from entitymill.operators import dedup
from entitymill.operators.scale import HOT_ROWS
from entitymill.session import cut_lineage, path_exists

KEY_ROWS = "scope string, seq bigint, rank int, key string, holds boolean, probes boolean, accepted boolean"
#: Ordinary state stores do not offer the states used here.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class EarliestHolder(StatefulProcessor):
    """Hands new key rows through, with a row for the earliest accepted holder known so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._taken = handle.getValueState("taken", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken = int(self._taken.get()[0]) if self._taken.exists() else None
        known, asked = taken, False
        for row in rows:  # one at a time, so a busy key is not held
            if row.accepted:
                taken = row.seq if taken is None else min(taken, row.seq)
            else:
                asked = True
                yield row
        if taken != known:
            self._taken.update((taken,))
        if asked and taken is not None:
            yield Row(scope=None, seq=taken - dedup.PRIOR, rank=0, key=key[0], holds=True, probes=False, accepted=True)

    def close(self) -> None:
        pass


def _accepted_holders(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Key rows of the records of a batch that were accepted, one per key."""
    own = rows.filter("holds AND NOT accepted").join(rejected, ["scope", "seq"], "left_anti")
    return own.groupBy("key").agg(F.min("seq").alias("seq")).select(
        F.lit(None).cast("string").alias("scope"), "seq", F.lit(0).alias("rank"), "key", F.lit(True).alias("holds"), F.lit(False).alias("probes"), F.lit(True).alias("accepted"))


def settle_batch(rows: DataFrame, batch_id: int, path: str, signals: list[dedup.Signal], hot_rows: int = HOT_ROWS) -> None:
    """Decide a batch of key rows and write its rejected records and what its accepted ones hold.

    Folders are named by the batch and overwritten when it is repeated; a state
    that reads what a repeated batch accepted twice stays the same.
    """
    known = cut_lineage(rows)
    rejected = cut_lineage(dedup.rejected_of(known, hot_rows))
    dedup.reasons(known, rejected, signals, hot_rows).write.mode("overwrite").parquet(f"{path}/duplicates/batch={batch_id}")
    _accepted_holders(known, rejected).write.mode("overwrite").parquet(f"{path}/accepted/batch={batch_id}")


def start(
    spark: SparkSession, listings: DataFrame, path: str, checkpoint: str, signals: list[dedup.Signal] | None = None,
    scope: str = "run_id", order: str = "seq", hot_rows: int = HOT_ROWS,
) -> StreamingQuery:
    """Settle what has arrived as one batch and stop; started again it goes on where it was.

    ``listings`` is a stream. Records of a start come after those of earlier
    starts. A start reads all that is there as one batch, so its states hold
    what every earlier batch accepted.
    """
    signals = signals or dedup.listing_signals()
    if not path_exists(spark, f"{path}/accepted"):
        spark.createDataFrame([], KEY_ROWS).write.parquet(f"{path}/accepted/batch=-1")
    earlier = spark.readStream.schema(KEY_ROWS).option("recursiveFileLookup", "true").parquet(f"{path}/accepted")
    new = dedup.key_rows(listings, signals, scope, order).withColumn("accepted", F.lit(False))
    every = new.unionByName(earlier).groupBy("key").transformWithState(
        EarliestHolder(), outputStructType=KEY_ROWS, outputMode="Update", timeMode="None")
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:  # a query keeps the settings it was started with
        return every.writeStream.outputMode("update").foreachBatch(lambda rows, i: settle_batch(rows, i, path, signals, hot_rows)).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    """(scope, seq, dup_of, signal) of all records rejected so far."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/duplicates").select("scope", "seq", "dup_of", "signal")
