"""Recovery on a stream (B8): a periodic job that backfills whatever is missing now.

It runs as its own query over the gap-event log written by the gap tracker
(``foreachBatch``, every 10 s in production, ``availableNow`` in tests).  The
log is partitioned by date.  Each batch folds the dates that got new events,
takes the ranges still open from the batch before for all other dates, looks
every open number up in the archive and writes, under its batch id, what was
recovered and which ranges stay open.  So a number that the archive lacked is
looked up again in every batch, and no batch reads the log of a quiet date.

A replayed batch rewrites its own folders.  It may recover more than the
first try did, if the log or the archive has grown since; it never writes a
number twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import constants as C
from feedspark.operators.intervals import in_ranges
from feedspark.operators.recovery import backfill_ranges, open_ranges
from feedspark.session import materialize
from feedspark.streaming.gaps import EVENTS, fold_gap_events

RECOVERED = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
])
_BATCH = T.StructField("batch_id", T.LongType())
_OPEN = T.StructType([*EVENTS.fields[:2], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(path)


def recover(spark: SparkSession, events_path: str, archive: DataFrame, out: str, touched: DataFrame, batch_id: int) -> None:
    """One pass: fold the ``touched`` (channel, feed_date) pairs, look all open numbers up, write the outcome.

    With an empty ``touched`` it only tries the open ranges again.
    """
    keys = ["channel", "feed_date"]
    touched = materialize(touched.select(*keys).distinct(), "touched", spark)
    events = spark.read.schema(EVENTS).parquet(events_path).join(touched, keys, "left_semi")
    done = _stored(spark, f"{out}/recovered", RECOVERED).where(F.col("batch_id") < batch_id).select(*keys, "seq")
    folded = materialize(fold_gap_events(events).select(*keys, "lo", "hi"), "folded", spark)
    # a number may come late, after the archive gave it: it is in no range any more
    fresh = open_ranges(folded, in_ranges(done.join(touched, keys, "left_semi"), folded, keys)).select(*keys, "lo", "hi")
    before = _stored(spark, f"{out}/open", _OPEN).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
    now = materialize(fresh.unionByName(before.join(touched, keys, "left_anti")), "open", spark)
    found = backfill_ranges(now, archive).withColumn("source", F.lit("recovered"))
    found.write.mode("overwrite").parquet(f"{out}/recovered/batch_id={batch_id}")
    got = _stored(spark, f"{out}/recovered", RECOVERED).where(F.col("batch_id") == batch_id)
    open_ranges(now, got).select(*keys, "lo", "hi").write.mode("overwrite").parquet(f"{out}/open/batch_id={batch_id}")


def recovery_batch(spark: SparkSession, events_path: str, archive: DataFrame, out: str):
    """The ``foreachBatch`` body."""
    return lambda batch, batch_id: recover(spark, events_path, archive, out, batch, batch_id)


def prepare(spark: SparkSession, out: str) -> None:
    """Empty folders, so that the first batch has something to read."""
    spark.createDataFrame([], RECOVERED).write.mode("overwrite").parquet(f"{out}/recovered/batch_id=-1")
    spark.createDataFrame([], _OPEN).write.mode("overwrite").parquet(f"{out}/open/batch_id=-1")


def start_recovery(spark: SparkSession, events_path: str, archive: DataFrame, out: str,
                   checkpoint: str, available_now: bool = True, period: str = C.RECOVERY_PERIOD):
    """Start the recovery query over the gap-event files; returns the running query."""
    prepare(spark, out)
    stream = spark.readStream.schema(EVENTS).parquet(events_path)  # all new event files per trigger
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    return (
        stream.writeStream.foreachBatch(recovery_batch(spark, events_path, archive, out))
        .option("checkpointLocation", checkpoint)
        .trigger(**trig)
        .start()
    )


def read_recovered(spark: SparkSession, out: str) -> DataFrame:
    return _stored(spark, f"{out}/recovered", RECOVERED).drop("batch_id")
