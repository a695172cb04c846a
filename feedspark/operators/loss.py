"""Loss detection over received sequence numbers.

Gaps are found with ``lead`` over numbers sorted within (channel, feed_date,
bucket) where bucket = seq div width -- never over a whole date, so one hot
date spreads across many tasks.  The gaps that straddle buckets come from a
scan over per-bucket (min, max).  Duplicates give a difference
of 0 and add nothing, so no separate DISTINCT shuffle is needed.
"""

from __future__ import annotations

from math import ceil, log2
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark.operators.scan import scan

KEYS = ("channel", "feed_date")


def _bucketed(numbers: DataFrame, keys: Sequence[str], seq: str, width: int, opens: str | None = None) -> DataFrame:
    keys = list(keys)
    w = Window.partitionBy(*keys, "_b").orderBy("seq", "_opens")
    x = numbers.select(*keys, F.col(seq).alias("seq"), F.floor(F.col(seq) / F.lit(width)).alias("_b"),
                       (F.col(opens) if opens else F.lit(True)).alias("_opens"))
    return x.withColumn("_next", F.lead("seq").over(w))


def _apart(low: str, high: str) -> Column:
    """Whether there is a number between two others; never leaves the range of a bigint."""
    return F.when(F.col(high) > F.col(low), F.col(high) - 1 > F.col(low)).otherwise(F.lit(False))


def range_size(lo: str = "lo", hi: str = "hi") -> Column:
    """Numbers in lo..hi, exact over the whole bigint range."""
    big = "decimal(20,0)"
    return (F.col(hi).cast(big) - F.col(lo).cast(big) + F.lit(1)).cast(big)


def gap_ranges(numbers: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", width: int = C.SEQ_BUCKET,
               opens: str | None = None) -> DataFrame:
    """One row per run of lost numbers between two received neighbours: ``lo, hi, n``.

    Loss before the first or after the last received number of a group cannot
    be seen (same as the original receiver).  With the boolean column
    ``opens`` only what follows a number that has it set can be lost.  Gaps
    between buckets come from a scan over the buckets' edges, so sparse numbers,
    whose buckets are as many as they are, make no window over a whole group.
    """
    keys = list(keys)
    x = _bucketed(numbers, keys, seq, width, opens)
    inner = x.where(F.col("_opens") & _apart("seq", "_next")).select(
        *keys, (F.col("seq") + 1).alias("lo"), (F.col("_next") - 1).alias("hi")
    )
    edges = x.groupBy(*keys, "_b").agg(F.min("seq").alias("_mn"), F.max(F.struct("seq", "_opens")).alias("_last"))
    cross = (
        scan(edges, keys, ["_b"], follow=F.col("_mn"))
        .select(*keys, F.col("_last.seq").alias("_mx"), F.col("_last._opens").alias("_opens"), F.col("following").alias("_nmn"))
        .where(F.col("_opens") & _apart("_mx", "_nmn"))
        .select(*keys, (F.col("_mx") + 1).alias("lo"), (F.col("_nmn") - 1).alias("hi"))
    )
    return inner.unionByName(cross).withColumn("n", range_size())


def expand_ranges(ranges: DataFrame, keys: Sequence[str] = KEYS, chunk: int = C.EXPAND_CHUNK) -> DataFrame:
    """L4: one row per lost number.

    Ranges stay ranges until here.  They are cut level by level: each level
    turns a range into at most ``chunk`` parts, as many levels as the bigint
    range needs, and an ordinary gap passes all of them as one part.  No array
    is longer than ``chunk``, and the parts of a huge range are spread over the
    cluster before the next level.
    """
    keys = list(keys)
    pieces = ranges.select(*keys, "lo", "hi")
    for level in range(ceil(64 / log2(chunk)) - 1, 0, -1):
        width = chunk ** level
        part = F.lit(width).cast("decimal(20,0)")
        count = F.floor((range_size() - 1) / part).cast("bigint")
        at = (F.col("lo").cast("decimal(38,0)") + F.col("_k") * part)
        pieces = pieces.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), count))).select(
            *keys, at.cast("bigint").alias("lo"), F.least(F.col("hi").cast("decimal(38,0)"), at + part - 1).cast("bigint").alias("hi"))
        pieces = pieces.repartition(*keys, "lo") if level > 1 else pieces
    return pieces.repartition(*keys, "lo").select(*keys, F.explode(F.sequence("lo", "hi")).alias("seq"))


def gaps(numbers: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", width: int = C.SEQ_BUCKET) -> DataFrame:
    """Missing numbers: ``channel, feed_date, seq``."""
    return expand_ranges(gap_ranges(numbers, keys, seq, width), keys)


def loss_summary(numbers: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", width: int = C.SEQ_BUCKET) -> DataFrame:
    """L8 per group: received rows, distinct numbers, duplicates, first, last, lost."""
    keys = list(keys)
    x = _bucketed(numbers, keys, seq, width)
    per_bucket = x.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(F.col("_next") == F.col("seq"), 1).otherwise(0)).alias("_dups"),
        F.min("seq").alias("_mn"),
        F.max("seq").alias("_mx"),
    )
    s = per_bucket.groupBy(*keys).agg(
        F.sum("_rows").cast("bigint").alias("received"),
        (F.sum("_rows") - F.sum("_dups")).cast("bigint").alias("distinct_numbers"),
        F.sum("_dups").cast("bigint").alias("duplicates"),
        F.min("_mn").alias("first_seq"),
        F.max("_mx").alias("last_seq"),
    )
    return s.withColumn("lost", (range_size("first_seq", "last_seq") - F.col("distinct_numbers")).cast("decimal(20,0)"))


def live_dates(packets: DataFrame, keep: int = 2) -> DataFrame:
    """Per channel, the last ``keep`` dates by first arrival are tracked for loss.

    Every date stays in the feed; only tracking is limited.  The window runs
    over one row per (channel, date).
    """
    d = packets.groupBy("channel", "feed_date").agg(
        F.min("arrival_ts").alias("first_arrival"), F.count(F.lit(1)).alias("packets")
    )
    w = Window.partitionBy("channel").orderBy(F.col("first_arrival").desc(), F.col("feed_date").desc())
    return d.withColumn("arrival_rank", F.row_number().over(w)).withColumn("tracked", F.col("arrival_rank") <= keep)


def date_status(packets: DataFrame) -> DataFrame:
    """Every packet with the standing of its date when it came: ``date_status``, and ``dates_seen`` of its channel by then.

    Packets come in the order of (arrival_ts, seq, feed_date).  The first one
    of a date makes the date known ("new"); later ones are "next" if their date
    is the last that became known, "current" if it is the one before (or the
    only one), and "late" if two dates became known after it: its date is no
    longer tracked.  Rows that are equal in all three columns came at once.  A
    packet without a time came first.
    """
    came = F.struct("arrival_ts", "seq", "feed_date")
    dates = packets.groupBy("channel", "feed_date").agg(F.min(came).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("_first"))        # a row per (channel, date)
    dates = dates.withColumn("_rank", rank)
    known = dates.select("channel", F.col("_first").alias("_came"), F.lit(0).alias("_kind"), F.col("_rank").alias("_seen"))
    own = dates.select(F.col("channel").alias("_c"), F.col("feed_date").alias("_d"), "_first", "_rank")
    rows = packets.withColumn("_came", came).join(
        own, F.col("channel").eqNullSafe(F.col("_c")) & F.col("feed_date").eqNullSafe(F.col("_d")))
    rows = rows.select("channel", "_came", F.lit(1).alias("_kind"), F.struct(*packets.columns).alias("_row"), "_first", "_rank")
    line = scan(rows.unionByName(known, allowMissingColumns=True), ["channel"], ["_came", "_kind"], carry=F.col("_seen")).where("_kind = 1")
    newest = F.col("carried")
    status = (F.when(F.col("_came").eqNullSafe(F.col("_first")), "new").when((F.col("_rank") == newest) & (newest > 1), "next")
              .when(F.col("_rank") >= newest - 1, "current").otherwise("late"))
    return line.select("_row.*", newest.cast("int").alias("dates_seen"), status.alias("date_status"))


def tracked(packets: DataFrame, keep: int = 2) -> DataFrame:
    """The packets of the tracked dates: what loss is looked for in when the live-date rule applies."""
    live = live_dates(packets, keep).where("tracked").select("channel", "feed_date")
    return packets.join(live, ["channel", "feed_date"], "left_semi")
