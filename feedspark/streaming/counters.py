"""Counters of a running gate (L8): metrics that the stream observes anyway, one small file per micro-batch.

``watch`` names the aggregates that the gate computes while it judges; no
packet is read again.  ``BatchCounters`` listens to the query's progress and
writes what each batch observed under its batch id, so a batch that is run
again after a failure replaces its own figures.  Figures of a batch that ends
just before the driver does may be missing: they are a report, not the feed.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from feedspark.operators import packets as P

NAME = "gate_counters"
STATUSES = [P.PASSED_CURRENT, P.PASSED_PREVIOUS, P.BAD_SECRET, P.NO_KEY, P.INCOMPLETE]
COUNTS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("channel", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("packets", T.LongType()),
    T.StructField("oversize", T.LongType()),
])


def watch(channels: Sequence[str]) -> list[Column]:
    """Aggregates per (channel, status) for the channels of the feed; all others are counted together."""
    cols = []
    for i, channel in enumerate([*channels, None]):
        of = F.col("channel") == channel if channel is not None else ~F.coalesce(F.col("channel").isin(*channels), F.lit(False))
        for j, status in enumerate(STATUSES):
            hit = of & (F.col("status") == status)
            cols += [F.count_if(hit).alias(f"n_{i}_{j}"), F.count_if(hit & P.oversize(F.col("wire"))).alias(f"o_{i}_{j}")]
    return cols


class BatchCounters(StreamingQueryListener):
    """Appends the observed counts of every micro-batch of the queries that ``watch`` the same channels; see ``read_counters``."""

    def __init__(self, spark: SparkSession, channels: Sequence[str], out: str):
        self.spark, self.channels, self.out = spark, [*channels, None], out
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(NAME)
        if seen is not None:
            batch = event.progress.batchId
            rows = [(batch, channel, status, seen[f"n_{i}_{j}"], seen[f"o_{i}_{j}"]) for i, channel in enumerate(self.channels)
                    for j, status in enumerate(STATUSES) if seen[f"n_{i}_{j}"]]
            self.spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counts per (channel, status) over all batches so far."""
    rows = spark.read.schema(COUNTS).parquet(out)
    return rows.groupBy("channel", "status").agg(F.sum("packets").alias("packets"), F.sum("oversize").alias("oversize"))
