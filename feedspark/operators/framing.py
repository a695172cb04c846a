"""Framing (M1-M3): cut messages into 1,024-byte frames and put them back together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark.operators.numbering import number_rows
from feedspark.session import materialize


def frame_count(nbytes, size: int = C.FRAME_SIZE) -> F.Column:
    """Frames of ``size`` bytes for a message: at least one; a message of exactly ``size`` bytes is one frame."""
    return F.greatest(F.ceil(nbytes / F.lit(size)), F.lit(1)).cast("bigint")


def split_frames(messages: DataFrame, channel: str, order: str, text: str, size: int = C.FRAME_SIZE,
                 lead_order=()) -> DataFrame:
    """M1: one row per frame -- ``channel, pos, mtext (binary), full_msg``.

    ``pos`` is the dense position of the frame in its channel's stream,
    messages taken in ``order``: the first frame of a message sits at the
    running total of frames of the messages before it (``number_rows``).  ``full_msg`` is 1 on the last frame of a message.
    ``lead_order`` columns come before ``order`` (e.g. date, then number).
    """
    lead_order = list(lead_order)
    m = messages.select(
        F.col(channel).alias("channel"),
        *lead_order,
        F.col(order).alias("_order"),
        F.encode(F.col(text), "UTF-8").alias("_bytes"),
    ).withColumn("_nf", frame_count(F.octet_length("_bytes"), size)).withColumn("_row", F.monotonically_increasing_id())
    m = materialize(m, "messages")
    # numbered without their texts, which then meet their numbers by row
    numbered = number_rows(m.drop("_bytes"), ["channel"], [*lead_order, "_order"], out="_first", weight_col="_nf")
    m = m.select("_row", "_bytes").join(numbered, "_row")
    f = m.select(
        "channel", "_order", "_bytes", "_nf", "_first",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nf") - 1)).alias("_i"),
    )
    return f.select(
        "channel",
        (F.col("_first") + F.col("_i")).alias("pos"),
        F.col("_bytes").substr(F.col("_i") * size + 1, F.lit(size)).alias("mtext"),
        F.when(F.col("_i") == F.col("_nf") - 1, 1).otherwise(0).cast("int").alias("full_msg"),
    )


def _message_ids(frames: DataFrame, bucket_width: int = 1 << 14) -> DataFrame:
    """Message id of every frame = number of closing flags before it in its channel.

    ``bucket_width`` frames (16 MiB of 1,024-byte frames) are the most that one
    window holds.  Two levels: flags per (channel, pos bucket) give each bucket an offset;
    inside a bucket a running sum does the rest.
    """
    x = frames.withColumn("_b", F.floor(F.col("pos") / F.lit(bucket_width)))
    per_bucket = x.groupBy("channel", "_b").agg(F.sum("full_msg").cast("bigint").alias("_flags"))
    wo = Window.partitionBy("channel").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("channel", "_b", F.coalesce(F.sum("_flags").over(wo), F.lit(0)).alias("_off"))
    j = x.join(offsets, ["channel", "_b"])
    wi = Window.partitionBy("channel", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn("msg_id", (F.col("_off") + F.coalesce(F.sum("full_msg").over(wi), F.lit(0))).cast("bigint")).drop(
        "_b", "_off"
    )


def join_frames(frames: DataFrame) -> DataFrame:
    """M2 + M3: reassemble messages; a message whose closing frame has not arrived is held back.

    Output: ``channel, msg_id, first_pos, n_frames, message (string), n_bytes``.
    Each group is one message (bounded by that message's own size).
    """
    ids = _message_ids(frames)
    g = ids.groupBy("channel", "msg_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "mtext"))).alias("_f"),
        F.max("full_msg").alias("_closed"),
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    done = g.where(F.col("_closed") == 1)
    joined = F.unhex(F.array_join(F.transform("_f", lambda s: F.hex(s["mtext"])), ""))
    return done.select(
        "channel", "msg_id", "first_pos", "n_frames",
        joined.cast("string").alias("message"),
        F.octet_length(joined).alias("n_bytes"),
    )


def pending_frames(frames: DataFrame) -> DataFrame:
    """M3: frames of the open tail (after the last closing flag) of each channel."""
    ids = _message_ids(frames)
    closed = ids.groupBy("channel", "msg_id").agg(F.max("full_msg").alias("_closed"))
    return ids.join(closed.where(F.col("_closed") == 0), ["channel", "msg_id"], "left_semi")


def frame_state(frames: DataFrame) -> DataFrame:
    """Per channel: complete messages, frames and bytes still held back."""
    ids = _message_ids(frames)
    per_msg = ids.groupBy("channel", "msg_id").agg(
        F.max("full_msg").alias("_closed"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("mtext")).alias("_b")
    )
    return per_msg.groupBy("channel").agg(
        F.sum(F.when(F.col("_closed") == 1, 1).otherwise(0)).cast("bigint").alias("complete_msgs"),
        F.sum(F.when(F.col("_closed") == 0, F.col("_n")).otherwise(0)).cast("bigint").alias("pending_frames"),
        F.sum(F.when(F.col("_closed") == 0, F.col("_b")).otherwise(0)).cast("bigint").alias("pending_bytes"),
    )
