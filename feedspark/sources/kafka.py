"""Packets from a Kafka topic (S1): the topic's records mapped onto the wire schema.

One record is one packet: ``value`` is the packet text, ``key`` names the
channel (or a fixed channel is given), and the broker timestamp is the
arrival time.  Everything after this mapping is the same gate / decode /
parse as for landed files.  The Kafka connector is not bundled with Spark;
``read_wire_kafka`` needs ``spark-sql-kafka`` on the classpath.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wire_from_kafka(records: DataFrame, channel: str | None = None) -> DataFrame:
    """Kafka source rows (key, value, topic, partition, offset, timestamp, ...) -> ``arrival_ts, channel, wire``."""
    ch = F.lit(channel) if channel is not None else F.coalesce(F.col("key").cast("string"), F.col("topic"))
    return records.select(
        F.col("timestamp").cast("timestamp_ntz").alias("arrival_ts"),
        ch.alias("channel"),
        F.col("value").cast("string").alias("wire"),
    )


def read_wire_kafka(spark: SparkSession, servers: str, topic: str, channel: str | None = None,
                    max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming wire rows from a topic; ``maxOffsetsPerTrigger`` bounds a micro-batch (back-pressure)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    try:
        return wire_from_kafka(r.load(), channel)
    except Exception as e:  # noqa: BLE001
        if "kafka" in str(e).lower():
            raise RuntimeError("the Kafka source needs spark-sql-kafka on the classpath") from e
        raise
