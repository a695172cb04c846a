"""Checked appends that count once (S3, S6): rows are staged, and a commit record makes them part of the table.

A table is a folder: ``data`` holds what each attempt at a batch has written,
good and refused rows of the attempt by one job, and ``commits`` one record
per batch that names its attempt.  Rows are read through the records, so good
and refused rows of a batch appear together or not at all; an attempt that
ended before its record is never seen, and a batch that has a record is not
written again.  Should two attempts commit the same batch, the record with the
smaller attempt name holds for every reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import constants as C

COMMITS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("attempt", T.StringType()),
    T.StructField("written", T.LongType()),
    T.StructField("refused", T.LongType()),
])


def faults(df: DataFrame, kinds: dict[str, T.DataType], required: set[str]) -> Column:
    """Why a table refuses a row, joined by '; ' (empty: it does not): nulls in required columns, values of another type."""
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in df.columns if c.lower() in required]
    found += [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c.lower()]).isNull(),
                     F.lit(f"{c} is not {kinds[c.lower()].simpleString()}"))
              for c in df.columns if c.lower() in kinds and df.schema[c].dataType != kinds[c.lower()]]
    return F.array_join(F.array_compact(F.array(*found)), "; ") if found else F.lit("")


def _data(schema: T.StructType) -> T.StructType:
    text = [T.StructField(f.name, T.StringType()) for f in schema.fields]
    return T.StructType([T.StructField("row", T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])),
                         T.StructField("raw", T.StructType(text)), T.StructField("reason", T.StringType()),
                         T.StructField("attempt", T.StringType()), T.StructField("refused", T.BooleanType())])


def create(spark: SparkSession, root: str) -> None:
    """An empty table at ``root``; one that is there stays as it is."""
    spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{root}/commits/batch=-1")
    spark.createDataFrame([], "reason string").write.mode("ignore").parquet(f"{root}/data/attempt=none/refused=false")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The record that holds for each batch."""
    records = spark.read.schema(COMMITS).parquet(f"{root}/commits")
    return records.groupBy("batch_id").agg(F.min_by(F.struct("attempt", "written", "refused"), "attempt").alias("r")).select("batch_id", "r.*")


def append_once(df: DataFrame, root: str, batch_id: int, schema: T.StructType, required: set[str] = frozenset(),
                before_commit: Callable[[], None] | None = None) -> tuple[int, int]:
    """Append a batch to a table of ``schema``, once however often it is tried: (rows written, rows refused).

    A row is refused for a null in a ``required`` column or a value that does
    not convert to the column's type; its values are kept as text with the
    reason.  A column that the table lacks is an error, never dropped; one that
    the batch lacks is null (and refused where required).  A batch with a record returns its counts and writes
    nothing.  ``before_commit`` runs between the staged write and the record.
    """
    spark = df.sparkSession
    done = commits(spark, root).where(F.col("batch_id") == batch_id).first()
    if done:
        return done.written, done.refused
    kinds, have = {f.name.lower(): f.dataType for f in schema.fields}, {c.lower(): c for c in df.columns}
    if lacking := sorted(set(have) - set(kinds)):
        raise ValueError(f"the table lacks the columns {', '.join(lacking)}")
    full = df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schema.fields])
    attempt, seen = uuid.uuid4().hex, Observation()
    reason = faults(full, kinds, {c.lower() for c in required})
    good = F.struct(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    raw = F.struct(*[F.col(f.name).cast("string").alias(f.name) for f in schema.fields])
    staged = full.select(reason.alias("reason"), good.alias("row"), raw.alias("raw"))
    staged = staged.withColumn("refused", F.col("reason") != "").select(
        F.when(~F.col("refused"), F.col("row")).alias("row"), F.when(F.col("refused"), F.col("raw")).alias("raw"), "reason", "refused")
    staged = staged.observe(seen, F.count_if(~F.col("refused")).alias("written"), F.count_if("refused").alias("refused"))
    staged.write.partitionBy("refused").parquet(f"{root}/data/attempt={attempt}")
    counts = seen.get
    if before_commit:
        before_commit()
    record = [(batch_id, attempt, counts["written"], counts["refused"])]
    spark.createDataFrame(record, COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits/batch={batch_id}")
    return counts["written"], counts["refused"]


def _committed(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(_data(schema)).parquet(f"{root}/data")
    return rows.join(commits(spark, root).select("attempt"), "attempt", "left_semi")


def read_written(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The table's rows."""
    return _committed(spark, root, schema).where("NOT refused").select("row.*")


def read_refused(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The refused rows, their values as text, with the ``_reason``."""
    return _committed(spark, root, schema).where("refused").select("raw.*", F.col("reason").alias("_reason"))


def start_append(stream: DataFrame, root: str, checkpoint: str, schema: T.StructType, required: set[str] = frozenset(),
                 available_now: bool = True, period: str = C.SCAN_PERIOD):
    """The running query: every micro-batch is appended once under its batch id."""
    create(stream.sparkSession, root)
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: append_once(batch, root, batch_id, schema, required) and None)
            .option("checkpointLocation", checkpoint).trigger(**trig).start())
