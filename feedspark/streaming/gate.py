"""Streaming ingest (S1, S9, L6): landed packet files -> gate/decode/parse -> packets table, with quarantine.

Keys rotate while the stream runs.  Every micro-batch reads the rotation
fold's output anew, so a packet is judged under the epochs known at that
moment.  A packet that fails under the last known epoch of its channel may be
one under a newer key: it is held and judged again when a newer epoch is
known.  A packet that fails under an epoch with a successor, or is incomplete,
is rejected for good.  Nothing is dropped: each batch id has its folder of
packets, of rejected rows with their reason, and of held rows, rewritten as a
whole when the batch is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import constants as C
from feedspark import schemas
from feedspark.operators import packets as P
from feedspark.operators.keys import key_epochs
from feedspark.session import conf_override, materialize, state_partitions

_HELD = T.StructType([*schemas.WIRE.fields, T.StructField("tried", T.IntegerType())])


def land_wire(wire: DataFrame, path: str, files: int = 8) -> str:
    """Append wire rows as ``files`` parquet files (arrival order mixed across files, like UDP)."""
    wire.repartition(files).write.mode("append").parquet(path)
    return path


def read_wire_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Packets landed as parquet files, read as a stream; all new files make a micro-batch unless a limit is set.

    The same transformations apply to a Kafka ``value`` column cast to string.
    """
    reader = spark.readStream.schema(schemas.WIRE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def trigger_options(available_now: bool = True, period: str = C.SCAN_PERIOD) -> dict:
    """L6/B8 trigger: a fixed period in production, ``availableNow`` in tests and backfills."""
    return {"availableNow": True} if available_now else {"processingTime": period}


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def gate_batch(spark: SparkSession, fold_path: str, out: str):
    """The ``foreachBatch`` body: judge new and held packets under the epochs known now.

    Writes ``out/packets``, ``out/rejected`` and ``out/held``, one folder per
    batch id.  A replayed batch reads the held rows of the batch before it
    again and rewrites its own folders.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        fold = spark.read.schema(schemas.KEY_FOLD).parquet(fold_path)
        epochs = materialize(key_epochs(fold), "epochs", spark)
        held = _stored(spark, f"{out}/held", _HELD).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        # a held packet has news only if its channel got an epoch after the one it was tried under
        last = epochs.groupBy(F.col("channel").alias("_c")).agg(F.max("epoch").alias("_last"))
        wire = held.unionByName(batch.select(*schemas.WIRE.fieldNames()).withColumn("tried", F.lit(None).cast("int")))
        due = wire.join(last, F.col("channel") == F.col("_c"), "left")
        news = F.col("tried").isNull() | (F.coalesce("_last", F.lit(-1)) > F.col("tried"))
        wait = due.where(~news).select(*_HELD.fieldNames())
        judged = P.parse_fields(P.decode_packets(due.where(news).select(*schemas.WIRE.fieldNames()), epochs))
        judged = materialize(judged.join(last, F.col("channel") == F.col("_c"), "left"), "judged", spark)
        newest = F.col("epoch").isNull() | (F.col("epoch") >= F.col("_last"))
        unsure = F.col("status").isin(P.BAD_SECRET, P.NO_KEY) & newest
        again = judged.where(unsure).select(*schemas.WIRE.fieldNames(), F.coalesce("_last", F.lit(-1)).cast("int").alias("tried"))
        parts = {"packets": P.complete_packets(judged), "rejected": P.quarantine_rows(judged.where(~unsure)),
                 "held": wait.unionByName(again)}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        spark.createDataFrame([(batch_id,)], "n long").write.mode("overwrite").parquet(f"{out}/batches/id={batch_id}")

    return run


def start_gate(stream: DataFrame, fold_path: str, out: str, checkpoint: str, available_now: bool = True,
               period: str = C.SCAN_PERIOD):
    """S9 start: the gate over a wire stream under the keys of a growing fold table.

    Started again with the same checkpoint it goes on where it stopped.
    Returns the running query (``.stop()`` ends it; ``awaitTermination`` for
    availableNow).
    """
    spark = stream.sparkSession
    for name, schema in (("packets", schemas.PACKETS), ("rejected", schemas.QUARANTINE), ("held", _HELD)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/{name}/batch_id=-1")
    spark.createDataFrame([(-1,)], "n long").write.mode("ignore").parquet(f"{out}/batches/id=-1")
    return (
        stream.writeStream.foreachBatch(gate_batch(spark, fold_path, out))
        .option("checkpointLocation", checkpoint).trigger(**trigger_options(available_now, period)).start()
    )


def read_packets(spark: SparkSession, out: str) -> DataFrame:
    """The packets that the gate has passed so far."""
    return _stored(spark, f"{out}/packets", schemas.PACKETS).drop("batch_id")


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    """Rows rejected for good, with their reason."""
    return _stored(spark, f"{out}/rejected", schemas.QUARANTINE).drop("batch_id")


def last_batch(spark: SparkSession, out: str) -> int:
    """Id of the last batch that the gate has finished (-1: none)."""
    return int(spark.read.schema("n long").parquet(f"{out}/batches").agg(F.max("n")).first()[0])


def read_waiting(spark: SparkSession, out: str) -> DataFrame:
    """Rows held for a newer key, with the reason that holds if none comes."""
    held = _stored(spark, f"{out}/held", _HELD).where(F.col("batch_id") == last_batch(spark, out))
    reason = F.when(F.col("tried") < 0, P.NO_KEY).otherwise(P.BAD_SECRET)
    return held.select("arrival_ts", "channel", "wire", reason.alias("reason"))


def gate_counts(spark: SparkSession, out: str) -> DataFrame:
    """L8 counters of the stream: rows per (channel, outcome): passed, the reason of a rejection, or waiting."""
    rows = read_packets(spark, out).select("channel", F.lit("passed").alias("outcome"))
    rows = rows.unionByName(read_rejected(spark, out).select("channel", F.col("reason").alias("outcome")))
    rows = rows.unionByName(read_waiting(spark, out).select("channel", F.lit("waiting").alias("outcome")))
    return rows.groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("packets"))


def start_gaps(packets_stream: DataFrame, sink_path: str, checkpoint: str,
               available_now: bool = True, period: str = C.SCAN_PERIOD, retention_s: int | None = None,
               partitions: int | None = None):
    """Stateful gap tracking over a packets stream; appends opened / closed / bounds / evicted rows.

    ``retention_s`` bounds the state of an endless feed (dates leave tracking);
    ``partitions`` is the state-store partition count (fixed at first start).
    """
    from feedspark.streaming.gaps import gap_events

    spark = packets_stream.sparkSession
    with conf_override(spark, spark__sql__shuffle__partitions=state_partitions(spark, partitions)):
        return (
            gap_events(packets_stream, retention_s=retention_s).writeStream.format("parquet")
            .partitionBy("feed_date").option("path", sink_path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**trigger_options(available_now, period))
            .start()
        )
