"""Feed writer (the sending side): key schedule, control replies and packets.

``encode_packets`` turns any feed-shaped DataFrame into wire rows the way the
sender does: ``secret + '^' + date ^ number ^ message``, XOR with the cipher,
base64.  ``legacy_plaintext`` is the older layout with a byte-sum checksum.

The test fixture (``demo_*``) adds deterministic damage by residue of the
sequence number so every gate branch is exercised on the real tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark.functions.codec import b64_encode, byte_sum, xor_bytes

# ---- fixed values (invented test keys; no real key is used anywhere) ---------
BOOTSTRAP_KEY = "boot-key-x"
WRONG_SECRET = "nosecret00"
DAILY_REFRESH = "86400"
# Damage by residue of the number, first match wins:
#   % 17 = 3 never sent; % 13 = 0 wrong secret; % 11 = 0 previous key;
#   % 29 = 0 message padded past 5,000 bytes; % 31 = 0 empty message;
#   % 37 = 0 two more fields behind the message.
# Keys by epoch: % 10 = 3 refresh "0"; % 10 = 4 a malformed reply comes first;
#   % 10 = 5 a cipher outside the key charset; % 10 = 7 a secret that is not 10 bytes.
PAD_CHAR = "."
# ------------------------------------------------------------------------------


def plaintext(secret, feed_date, seq, message, sep: str = C.FIELD_SEP) -> Column:
    """``secret`` + one separator byte + ``date^number^message``."""
    return F.concat(secret, F.lit(sep), feed_date, F.lit(sep), seq.cast("string"), F.lit(sep), message)


def legacy_plaintext(secret, feed_date, seq, message) -> Column:
    """Older layout: ``secret + checksum ^ date ^ number ^ 0 ^ message``.

    The checksum is the byte sum of everything from the first ``^``.
    """
    tail = F.concat(F.lit("^"), feed_date, F.lit("^"), seq.cast("string"), F.lit("^0^"), message)
    return F.concat(secret, byte_sum(tail).cast("string"), tail)


def encode(plain, key) -> Column:
    """XOR with the key, then one-line base64."""
    return b64_encode(xor_bytes(plain, key))


# ---------------------------------------------------------------------------
# key schedule and control replies
# ---------------------------------------------------------------------------

def demo_key_schedule(feed: DataFrame) -> DataFrame:
    """One key epoch per day present in the feed (server side, plain text).

    cipher ``k<ord>cipher`` right-padded with '0' to 10 bytes, secret
    ``secret<ord:4>``, with the faults by epoch listed above.  The distinct days are a calendar-sized
    set, so the window below runs over a handful of rows per channel.
    """
    days = feed.groupBy("channel", "day").agg(F.min("arrival_ts").alias("_first"))
    w = Window.partitionBy("channel").orderBy("day")
    sched = days.select(
        "channel",
        (F.row_number().over(w) - 1).cast("int").alias("ord"),
        F.col("day").alias("effective_from"),
    )
    sched = sched.select(
        "channel",
        "ord",
        "effective_from",
        F.rpad(F.concat(F.lit("k"), F.col("ord").cast("string"), F.when(F.col("ord") % 10 == 5, F.lit("_")).otherwise(F.lit("")),
                        F.lit("cipher")), 10, "0").alias("cipher"),
        F.concat(F.when(F.col("ord") % 10 == 7, F.lit("short")).otherwise(F.lit("secret")),
                 F.lpad(F.col("ord").cast("string"), 4, "0")).alias("secret"),
        F.when(F.col("ord") % 10 == 3, F.lit("0")).otherwise(F.lit(DAILY_REFRESH)).alias("refresh_text"),
    )
    w2 = Window.partitionBy("channel").orderBy("ord")
    return sched.select(
        "*",
        F.lag("cipher").over(w2).alias("prev_cipher"),
        F.lag("secret").over(w2).alias("prev_secret"),
    )


def control_replies(schedule: DataFrame, bootstrap_key: str = BOOTSTRAP_KEY) -> DataFrame:
    """Encode each rotation message ``cipher^secret^seconds`` with the cipher it replaces.

    Where ``ord % 10 = 4`` a malformed reply (two fields) comes right before
    the good one, at the same instant; replies are numbered without a gap.
    """
    key = F.coalesce(F.col("prev_cipher"), F.lit(bootstrap_key))
    good = F.struct((F.col("ord") + F.floor((F.col("ord") + 6) / 10)).cast("int").alias("ord"),
                    F.concat_ws(C.FIELD_SEP, "cipher", "secret", "refresh_text").alias("body"))
    bad = F.struct((good["ord"] - 1).alias("ord"), F.concat_ws(C.FIELD_SEP, "cipher", "secret").alias("body"))
    both = F.when(F.col("ord") % 10 == 4, F.array(bad, good)).otherwise(F.array(good))
    x = schedule.select("channel", "effective_from", key.alias("_key"), F.explode(both).alias("r"))
    return x.select(
        "channel",
        F.col("r.ord").alias("ord"),
        F.col("effective_from").alias("arrival_ts"),
        encode(F.col("r.body"), F.col("_key")).alias("wire"),
    )


# ---------------------------------------------------------------------------
# packets
# ---------------------------------------------------------------------------

def demo_damage(seq: Column) -> Column:
    """Damage kind of a number (first match wins), ``None`` for a clean packet."""
    return (
        F.when(seq % 17 == 3, F.lit("dropped"))
        .when(seq % 13 == 0, F.lit("wrong_secret"))
        .when(seq % 11 == 0, F.lit("previous_key"))
        .when(seq % 29 == 0, F.lit("oversize"))
        .when(seq % 31 == 0, F.lit("empty"))
        .when(seq % 37 == 0, F.lit("extra"))
    )


def demo_wire(feed: DataFrame, schedule: DataFrame, with_truth: bool = False) -> DataFrame:
    """Wire rows for the feed with the deterministic damage applied.

    The schedule has one row per (channel, day): a calendar-bounded table, so
    the equi-join on (channel, day) is a broadcast hash join chosen by Spark's
    own size estimate, with sort-merge beyond it.
    """
    dmg = demo_damage(F.col("seq"))
    keys = schedule.select(
        "channel", F.col("effective_from").alias("day"), "cipher", "secret", "prev_cipher", "prev_secret"
    )
    f = feed.withColumn("damage", dmg).where(F.col("damage").isNull() | (F.col("damage") != "dropped"))
    f = f.join(keys, ["channel", "day"], "inner")
    use_prev = (F.col("damage") == "previous_key") & F.col("prev_cipher").isNotNull()
    secret = (
        F.when(F.col("damage") == "wrong_secret", F.lit(WRONG_SECRET))
        .when(use_prev, F.col("prev_secret"))
        .otherwise(F.col("secret"))
    )
    cipher = F.when(use_prev, F.col("prev_cipher")).otherwise(F.col("cipher"))
    message = (
        F.when(F.col("damage") == "oversize", F.concat("message", F.expr(f"repeat('{PAD_CHAR}', {C.MAX_PACKET_BYTES})")))
        .when(F.col("damage") == "empty", F.lit(""))
        .when(F.col("damage") == "extra", F.concat("message", F.lit("^x^y")))
        .otherwise(F.col("message"))
    )
    out = f.select(
        "arrival_ts",
        "channel",
        encode(plaintext(secret, F.col("feed_date"), F.col("seq"), message), cipher).alias("wire"),
        "seq",
        "damage",
    )
    return out if with_truth else out.drop("seq", "damage")


def encode_packets(feed: DataFrame, keys: DataFrame) -> DataFrame:
    """S2 for any feed: ``feed(channel, day, feed_date, seq, message, arrival_ts)`` joined to the
    (channel, day) key table ``keys(channel, day, cipher, secret)``."""
    f = feed.join(keys, ["channel", "day"], "inner")
    return f.select(
        "arrival_ts",
        "channel",
        encode(plaintext(F.col("secret"), F.col("feed_date"), F.col("seq"), F.col("message")), F.col("cipher")).alias("wire"),
    )
