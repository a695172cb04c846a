"""Delivery (S7, S8, S11): one feed, delivered as table rows or as frames, from batches and streams; consumers."""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import schemas
from feedspark.operators.framing import split_frames
from feedspark.session import materialize
from feedspark.sinks import tables as S
from feedspark.sources.delivered import ROWS, ids_path

_RECORD = "n long, first long, last long"
_STORED = T.StructType([*ROWS.fields, T.StructField("batch_id", T.LongType())])


def feed_frames(feed: DataFrame) -> DataFrame:
    """The feed as a frame stream per channel, messages in (feed_date, seq) order."""
    return split_frames(feed, channel="channel", order="seq", text="message", lead_order=("feed_date",))


def deliver_batch(feed: DataFrame, path: str, batch_id: int) -> None:
    """S5+S11: one batch of the feed into a path table, ids going on from the batches before it.

    The batch has its own folder, so a replay overwrites its own rows and gets
    the same ids: they start behind the last id of the earlier batches, which
    a record per batch keeps (no row delivered earlier is read).  The record is
    written last: a consumer sees a batch once it is complete.
    """
    spark = feed.sparkSession
    _prepare(spark, path)
    start = (_records(spark, path).where(F.col("n") < batch_id).agg(F.max("last")).first()[0] or 0) + 1
    batch = materialize(feed.select(*schemas.FEED.fieldNames()), "batch", spark)
    S.with_ids(batch, start=start).select(*ROWS.fieldNames()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    record = [(batch_id, start, start + batch.count() - 1)]
    spark.createDataFrame(record, _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{ids_path(path)}/batch={batch_id}")


def _prepare(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], ROWS).write.mode("ignore").parquet(f"{path}/batch_id=-1")
    spark.createDataFrame([(-1, 1, 0)], _RECORD).write.mode("ignore").parquet(f"{ids_path(path)}/batch=-1")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """One row per delivered batch: its id and the first and last row id (last < first: it had no rows)."""
    return spark.read.schema(_RECORD).parquet(ids_path(path))


def read_delivered(spark, path: str) -> DataFrame:
    """All delivered rows: id and the feed's columns."""
    return spark.read.schema(_STORED).parquet(path).drop("batch_id")


def deliver(feed: DataFrame, mode: str = "table", *, path: str | None = None, table: str | None = None,
            jdbc_url: str | None = None, jdbc_table: str | None = None, jdbc_properties: dict | None = None) -> None:
    """The same feed to a table (path, catalog or JDBC, with serial ids) or as frames.

    Ids go on from what the target holds; deliveries to one target must follow
    each other.
    """
    spark = feed.sparkSession
    if mode == "table":
        if path:
            _prepare(spark, path)
            deliver_batch(feed, path, _records(spark, path).agg(F.max("n")).first()[0] + 1)
        elif table:
            S.append_table(S.with_ids(feed, start=S.next_id(spark.table(table))), table)
        elif jdbc_url:
            name = jdbc_table or "feed"
            try:
                start = S.next_id(spark.read.jdbc(jdbc_url, name, properties=jdbc_properties))
            except Exception as e:  # drivers raise their own kinds for a table that is not there yet
                if "exist" not in str(e).lower():
                    raise
                start = 1
            S.append_jdbc(S.with_ids(feed, start=start), jdbc_url, name, jdbc_properties)
        else:
            raise ValueError("table mode needs path, table or jdbc_url")
    elif mode == "frames":
        if not path:
            raise ValueError("frames mode needs path")
        feed_frames(feed).write.mode("append").partitionBy("channel").parquet(path)
    else:
        raise ValueError(f"unknown delivery mode {mode!r}")


def start_delivery(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, period: str = "2 seconds"):
    """S11 as a running query: every micro-batch of a feed stream goes into the path table, once per batch id."""
    return start_consumer(stream, lambda batch, batch_id: deliver_batch(batch, path, batch_id), checkpoint, available_now, period)


def consume(feed: DataFrame, fn: Callable[[Iterable[Row]], None], order=("channel", "feed_date", "seq")) -> None:
    """Items in feed order, one contiguous run per task: ``fn`` gets the rows of its run, sorted, on the executor."""
    n = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feed.repartitionByRange(n, *order).sortWithinPartitions(*order).foreachPartition(fn)


def start_consumer(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
                   available_now: bool = True, period: str = "2 seconds"):
    """User code over every micro-batch of a feed stream (``foreachBatch``)."""
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(**trig).start()
