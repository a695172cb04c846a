"""Recovery by requests on a clock (B6, B8): a quiet feed is asked for again, and attempts are counted.

One streaming query reads the gap-event log together with a clock, a source
that has one row per trigger.  So a micro-batch runs at every tick (10 s in
production) even if no gap event came in.  A tick takes the ranges open after
the tick before, folds the dates that got new events anew, asks for every lost
number that no pending request covers, asks again for the pending requests,
and writes what came back.  A request keeps its identity and its attempts
until a good reply answers it; numbers that a good reply lacks are asked for
at the next tick.

State between ticks is two small tables, the open ranges and the pending
requests, each in two folders that ticks use in turn: a replayed tick reads
the folder that the tick before it wrote and overwrites its own.  Rows that
came back are kept per tick.  A replayed tick sends its requests again, as any
at-least-once sender does, and never writes a number twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import constants as C
from feedspark.operators.intervals import in_ranges, minus_ranges
from feedspark.operators.loss import range_size
from feedspark.operators.recovery import KEYS, open_ranges, recovery_round
from feedspark.session import materialize
from feedspark.streaming.gaps import EVENTS, fold_gap_events
from feedspark.streaming.recovery import _BATCH, _OPEN, RECOVERED

ANSWERED = T.StructType([*RECOVERED.fields, T.StructField("attempts", T.IntegerType())])
_RANGE = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
PENDING = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("batch_no", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()),
    T.StructField("parts", T.ArrayType(_RANGE)),
    T.StructField("date_b64", T.StringType()),
    T.StructField("missed_b64", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
])
Ask = Callable[[DataFrame, int], DataFrame]


def clock(spark: SparkSession) -> DataFrame:
    """A stream with one row per trigger, in the columns of gap events, all of them null."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields])


def _state(spark: SparkSession, out: str, name: str, tick: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/{name}/turn={tick % 2}")


def _answered(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(T.StructType([*ANSWERED.fields, _BATCH])).parquet(f"{out}/answered")


def retry(spark: SparkSession, events_path: str, ask: Ask, out: str, touched: DataFrame, tick: int,
          batch_size: int = C.BATCH_SIZE) -> None:
    """One tick: fold the ``touched`` (channel, feed_date) pairs, ask for all that is lost, keep what came back.

    ``ask`` gets requests (with ``parts`` and ``attempts``) and the tick, and
    gives (channel, feed_date, lo, hi, body).  Numbers in a reply that are not
    lost (any more) are not taken.
    """
    touched = materialize(touched.select(*KEYS).distinct(), "touched", spark)
    events = spark.read.schema(EVENTS).parquet(events_path).join(touched, KEYS, "left_semi")
    folded = materialize(fold_gap_events(events).select(*KEYS, "lo", "hi"), "folded", spark)
    done = _answered(spark, out).where(F.col("batch_id") < tick).select(*KEYS, "seq").join(touched, KEYS, "left_semi")
    fresh = open_ranges(folded, in_ranges(done, folded, KEYS)).select(*KEYS, "lo", "hi")
    before = _state(spark, out, "open", tick - 1, _OPEN).join(touched, KEYS, "left_anti")
    now = materialize(fresh.unionByName(before), "open", spark)
    pending = _state(spark, out, "pending", tick - 1, PENDING)
    asked = pending.select(*KEYS, F.explode("parts").alias("p")).select(*KEYS, "p.lo", "p.hi")
    ranges = minus_ranges(now, asked, KEYS).withColumn("n", range_size())
    went = recovery_round(ranges, pending, lambda sent: ask(sent, tick), batch_size)
    got = in_ranges(went.recovered, now, KEYS).dropDuplicates([*KEYS, "seq"])
    folder = f"{out}/answered/batch_id={tick}"
    got.select(ANSWERED.fieldNames()).write.mode("overwrite").parquet(folder)
    got = spark.read.schema(ANSWERED).parquet(folder)
    open_ranges(now, got).select(*KEYS, "lo", "hi").write.mode("overwrite").parquet(f"{out}/open/turn={tick % 2}")
    went.pending.select(PENDING.fieldNames()).write.mode("overwrite").parquet(f"{out}/pending/turn={tick % 2}")


def prepare(spark: SparkSession, out: str) -> None:
    """Empty tables for the first tick (0) to read; nothing of a stopped query is touched."""
    for name, schema in (("answered/batch_id=-1", ANSWERED), ("open/turn=1", _OPEN), ("pending/turn=1", PENDING)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/{name}")


def start_retries(spark: SparkSession, events_path: str, ask: Ask, out: str, checkpoint: str, available_now: bool = True,
                  period: str = C.RECOVERY_PERIOD, batch_size: int = C.BATCH_SIZE):
    """The running query; with ``available_now`` it takes the events there are, one tick, and ends."""
    prepare(spark, out)
    stream = spark.readStream.schema(EVENTS).parquet(events_path).unionByName(clock(spark))

    def tick(batch: DataFrame, batch_id: int) -> None:
        retry(spark, events_path, ask, out, batch.where(F.col("kind").isNotNull()), batch_id, batch_size)

    trig = {"availableNow": True} if available_now else {"processingTime": period}
    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**trig).start()


def read_answered(spark: SparkSession, out: str) -> DataFrame:
    """What came back: the rows, the attempt of the request that brought them, and the tick (``batch_id``)."""
    return _answered(spark, out)


def read_pending(spark: SparkSession, out: str, tick: int) -> DataFrame:
    """Requests without a good reply after ``tick``, the last one or the one before."""
    return _state(spark, out, "pending", tick, PENDING)
