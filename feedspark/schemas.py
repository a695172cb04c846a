"""Fixed schemas of the feed tables (nothing is inferred)."""

from pyspark.sql import types as T

WIRE = T.StructType([
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("channel", T.StringType()),
    T.StructField("wire", T.StringType()),
])

PACKETS = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("extra_fields", T.IntegerType()),
])

CONTROL_REPLIES = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("wire", T.StringType()),
])

KEY_EPOCHS = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("effective_from", T.TimestampNTZType()),
    T.StructField("cipher", T.StringType()),
    T.StructField("secret", T.StringType()),
    T.StructField("refresh_s", T.IntegerType()),
    T.StructField("prev_cipher", T.StringType()),
    T.StructField("prev_secret", T.StringType()),
])

# One row per control reply, good or bad, as the rotation fold leaves it.
KEY_FOLD = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("cipher", T.StringType()),
    T.StructField("secret", T.StringType()),
    T.StructField("refresh_s", T.IntegerType()),
    T.StructField("prev_cipher", T.StringType()),
    T.StructField("prev_secret", T.StringType()),
])

MISSING = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("seq", T.LongType()),
])

FEED = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
])

FRAMES = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("mtext", T.BinaryType()),
    T.StructField("full_msg", T.IntegerType()),
])

QUARANTINE = T.StructType([
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("channel", T.StringType()),
    T.StructField("wire", T.StringType()),
    T.StructField("reason", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("level", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("line", T.StringType()),
])
