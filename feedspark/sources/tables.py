"""Reading the input tables and mapping them onto the feed data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a test directory (schema comes from the file footer)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_as_feed(events: DataFrame, channels: int = 3) -> DataFrame:
    """The common feed built from ``events``.

    channel = ``ch`` + day of the month modulo ``channels``, feed_date =
    yyyyMMdd of ``ts``, seq = ``event_id``, message = ``props``, arrival_ts =
    ``ts``; ``day`` is the key-epoch day.
    """
    return events.select(
        F.concat(F.lit("ch"), (F.dayofmonth("ts") % channels).cast("string")).alias("channel"),
        F.date_format("ts", "yyyyMMdd").alias("feed_date"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("message"),
        F.col("ts").alias("arrival_ts"),
        F.date_trunc("DAY", "ts").alias("day"),
    )


def lineitem_as_numbers(lineitem: DataFrame) -> DataFrame:
    """Real numbering with gaps and duplicates: line numbers within each order."""
    return lineitem.select(
        F.lit("lineitem").alias("channel"),
        F.col("l_orderkey").cast("string").alias("feed_date"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
    )
