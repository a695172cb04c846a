"""Gate, decode, authenticate and parse packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark.functions.codec import b64_decode_prefix, b64_prefix, byte_sum, xor_authenticate
from feedspark.functions.text import atoi, split_fields
from feedspark.operators.keys import asof_keys

# ---- fixed values: status labels of the gate ---------------------------------
NO_KEY = "no_key"
BAD_SECRET = "bad_secret"
INCOMPLETE = "incomplete"
PASSED_CURRENT = "passed_current"
PASSED_PREVIOUS = "passed_previous"
# ------------------------------------------------------------------------------


def oversize(wire: Column) -> Column:
    """Packets of 5,000 bytes or more are labelled and counted; they are decoded and delivered like any other."""
    return F.octet_length(wire) >= C.MAX_PACKET_BYTES


def authenticate(keyed: DataFrame, wire: str = "wire") -> DataFrame:
    """R1 + P3 + P4 on rows that carry their key pair (see ``asof_keys``).

    Keyless rows are never decoded.  One Arrow pass per batch XORs with the current cipher, checks the secret, and retries the previous
    cipher only on the rows that failed.  Adds ``status`` and ``body`` (binary,
    after the secret and separator).  Each step is its own projection, so the
    base64 regex and the UDF run once per row.
    """
    x = keyed.withColumn("_b64", F.when(F.col("cipher").isNotNull(), b64_prefix(F.col(wire))))
    x = x.withColumn("_dec", b64_decode_prefix(F.col("_b64")))
    x = x.withColumn("_a", xor_authenticate("_dec", "cipher", "secret", "prev_cipher", "prev_secret"))
    code = F.col("_a.code")
    status = (
        F.when(F.col("cipher").isNull(), F.lit(NO_KEY))
        .when(code == 1, F.lit(PASSED_CURRENT))
        .when(code == 2, F.lit(PASSED_PREVIOUS))
        .otherwise(F.lit(BAD_SECRET))
    )
    return x.withColumn("status", status).withColumn("body", F.col("_a.body")).drop("_b64", "_dec", "_a")


def decode_packets(wire: DataFrame, epochs: DataFrame) -> DataFrame:
    """Gate + decode: wire rows -> ``arrival_ts, channel, wire, epoch, status, body``."""
    a = authenticate(asof_keys(wire, epochs))
    return a.select("arrival_ts", "channel", "wire", "epoch", "status", "body")


# A body is complete when date, number and message are all non-empty: two
# non-empty fields, each followed by '^', then at least one more character.
COMPLETE_BODY = r"^[^^]+\^[^^]+\^[^^]"


def parse_fields(decoded: DataFrame) -> DataFrame:
    """R2 + P5: split the body on '^'; date, number, message must all be non-empty.

    A short body is incomplete (each row stands alone); tokens after the third
    are ignored and counted in ``extra_fields``.  Rows that did not pass the
    gate keep their gate status.  Completeness is one anchored regex, so a
    filter on ``status`` never repeats the split.
    """
    text = F.col("body").cast("string")
    tok = split_fields(text)
    d, n, m = F.get(tok, 0), F.get(tok, 1), F.get(tok, 2)
    passed = F.col("status").isin(PASSED_CURRENT, PASSED_PREVIOUS)
    complete = F.coalesce(text.rlike(COMPLETE_BODY), F.lit(False))
    status = F.when(passed & ~complete, F.lit(INCOMPLETE)).otherwise(F.col("status"))
    return decoded.select(
        "channel",
        F.when(passed, d).alias("feed_date"),
        F.when(passed, atoi(n)).alias("seq"),
        F.when(passed, m).alias("message"),
        "arrival_ts",
        F.when(passed, F.greatest(F.size(tok) - 3, F.lit(0))).cast("int").alias("extra_fields"),
        status.alias("status"),
        "wire",
        "epoch",
    )


def complete_packets(parsed: DataFrame) -> DataFrame:
    """The packets table: complete rows only (R4 forwards every one of them, whatever its date)."""
    return parsed.where(F.col("status").isin(PASSED_CURRENT, PASSED_PREVIOUS)).select(
        "channel", "feed_date", "seq", "message", "arrival_ts", "extra_fields"
    )


def packets_from_wire(wire: DataFrame, epochs: DataFrame) -> DataFrame:
    """wire -> gate -> decode -> parse -> complete packets."""
    return complete_packets(parse_fields(decode_packets(wire, epochs)))


def gate_counts(parsed: DataFrame) -> DataFrame:
    """L8 counters: packets per (channel, status), and how many of them were oversize."""
    return parsed.groupBy("channel", "status").agg(
        F.count(F.lit(1)).alias("packets"), F.count(F.when(oversize(F.col("wire")), 1)).alias("oversize"))


def quarantine_rows(parsed: DataFrame) -> DataFrame:
    """Every gate failure with its reason (nothing is dropped silently)."""
    bad = ~F.col("status").isin(PASSED_CURRENT, PASSED_PREVIOUS)
    return parsed.where(bad).select("arrival_ts", "channel", "wire", F.col("status").alias("reason"))


# ---------------------------------------------------------------------------
# Legacy layout (checksum)
# ---------------------------------------------------------------------------

def legacy_check(df: DataFrame, body: str = "body") -> DataFrame:
    """Legacy body (after the 10-byte secret) ``checksum ^ date ^ number ^ 0 ^ message``.

    Adds the stated ``checksum``, the byte sum of everything from the first
    '^' (``computed``), the fields, and ``valid`` (sums agree, all fields
    present).  The byte sum runs once per row in its own projection.
    """
    b = F.col(body)
    text = b.cast("string")
    head_len = F.octet_length(F.substring_index(text, "^", 1).cast("binary"))
    rest = F.when(F.instr(text, "^") > 0, b.substr(head_len + 1, F.octet_length(b)))
    x = df.withColumn("_rest", rest).withColumn("computed", byte_sum(F.col("_rest")))
    tok = split_fields(text)
    stated = F.regexp_extract(text, r"^(\d*)\^", 1).try_cast("bigint")
    return x.select(
        "*",
        stated.alias("checksum"),
        F.get(tok, 1).alias("legacy_date"),
        atoi(F.get(tok, 2)).alias("legacy_seq"),
        F.get(tok, 4).alias("legacy_message"),
        F.coalesce((stated == F.col("computed")) & (F.size(tok) >= 5), F.lit(False)).alias("valid"),
    ).drop("_rest")
