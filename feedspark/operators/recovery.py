"""Recovery (backfill) of lost numbers: B1-B7, P7."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark.functions.codec import b64_encode
from feedspark.operators.intervals import in_ranges
from feedspark.operators.loss import gap_ranges
from feedspark.operators.numbering import number_rows
from feedspark.session import materialize

KEYS = ["channel", "feed_date"]


def assign_ranges(ranges: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """B1 on ranges: (channel, feed_date, batch_no, lo, hi), each range cut where a request batch ends.

    The batch of a lost number is its position among the lost numbers of its
    (channel, feed_date) div ``batch_size``; positions of ranges are running
    sums of their sizes, so no number is written out.  A batch has at most
    ``batch_size`` parts, and a huge range is cut in levels of bounded width.
    """
    r = ranges.select(*KEYS, "lo", "hi", F.col("n").cast("decimal(20,0)").alias("n"))
    p = number_rows(r, KEYS, ["lo"], out="at", weight_col="n")             # decimal positions: a range may be longer than a bigint
    p = p.withColumns({"b0": F.expr(f"at div {batch_size}"), "b1": F.expr(f"(at + n - 1) div {batch_size}")})
    wide = C.EXPAND_CHUNK
    p = p.withColumn("b0", F.explode(F.sequence(F.col("b0"), F.col("b1"), F.lit(wide * wide).cast("bigint"))))
    p = p.withColumn("b1", F.least("b1", F.col("b0") + wide * wide - 1))
    p = p.withColumn("b0", F.explode(F.sequence(F.col("b0"), F.col("b1"), F.lit(wide).cast("bigint"))))
    p = p.withColumn("b1", F.least("b1", F.col("b0") + wide - 1))
    p = p.withColumn("batch_no", F.explode(F.sequence("b0", "b1")))
    size, low = F.lit(batch_size).cast("decimal(20,0)"), F.col("lo").cast("decimal(20,0)")
    offset = (F.col("batch_no").cast("decimal(18,0)") * size - F.col("at")).cast("decimal(38,0)")    # of the batch in the range
    start = low + F.greatest(offset, F.lit(0).cast("decimal(38,0)"))
    end = low + F.least(offset + size - 1, F.col("n").cast("decimal(38,0)") - 1)
    return p.select(*KEYS, "batch_no", start.cast("bigint").alias("lo"), end.cast("bigint").alias("hi"))


def assign_batches(ranges: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """B1: the batch number of every lost number."""
    parts = assign_ranges(ranges, batch_size)
    return parts.select(*KEYS, F.explode(F.sequence("lo", "hi")).alias("seq"), "batch_no")


def request_counts(ranges: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """Lost numbers and request batches per (channel, feed_date), by arithmetic on the ranges."""
    c = ranges.groupBy(*KEYS).agg(F.sum("n").cast("decimal(20,0)").alias("lost"))
    return c.withColumn("requests", F.ceil(F.col("lost") / batch_size).cast("decimal(20,0)"))


def request_batches(ranges: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """B1+B2: lost numbers in order, ``batch_size`` per request, '^'-joined and base64 encoded.

    ``ceil(n / size)`` batches per date, none skipped, no stray separator;
    each group collects at most ``batch_size`` parts of ranges.
    """
    g = assign_ranges(ranges, batch_size).groupBy(*KEYS, "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    g = g.withColumn("_nums", F.flatten(F.transform("parts", lambda r: F.sequence(r["lo"], r["hi"]))))
    missed = F.array_join(F.transform("_nums", lambda s: s.cast("string")), C.FIELD_SEP)
    return g.select(
        *KEYS,
        "batch_no",
        F.size("_nums").cast("int").alias("n"),
        F.get("_nums", 0).alias("lo"),
        F.element_at("_nums", -1).alias("hi"),
        "parts",
        b64_encode(F.col("feed_date")).alias("date_b64"),
        b64_encode(missed).alias("missed_b64"),
    )


def request_body(requests: DataFrame) -> DataFrame:
    """The form body sent for one request batch."""
    return requests.withColumn(
        "post_body", F.concat(F.lit("date="), F.col("date_b64"), F.lit("&missed="), F.col("missed_b64"))
    )


def reply_ok(body: Column) -> Column:
    """At least 15 characters and they equal the header."""
    return F.coalesce((F.length(body) >= len(C.REPLY_HEADER)) & body.startswith(C.REPLY_HEADER), F.lit(False))


def parse_replies(replies: DataFrame, key_cols=("channel", "feed_date", "batch_no")) -> DataFrame:
    """One message per line after the header and one separator character.

    Only replies with a good header are read; an empty final line is not a
    message (a line reader does not produce it); a header-only reply has none.
    """
    key_cols = list(key_cols)
    ok = replies.where(reply_ok(F.col("body")))
    rest = F.col("body").substr(F.lit(C.REPLY_SKIP + 1), F.length("body"))
    lines = F.when(F.length(rest) == 0, F.array().cast("array<string>")).otherwise(
        F.split(F.when(rest.endswith("\n"), rest.substr(F.lit(1), F.length(rest) - 1)).otherwise(rest), "\n", -1)
    )
    return ok.select(*key_cols, F.posexplode(lines).alias("line_no", "message")).withColumn(
        "line_no", F.col("line_no").cast("int")
    )


def backfill(missing: DataFrame, archive: DataFrame) -> DataFrame:
    """Look every lost number up in the archive (message NULL when absent).

    One full pass over both sides: the archive's rows and the lost numbers
    meet in one join on (channel, feed_date, seq) that keeps the missing side.
    The key is close to unique, so a hot date still hashes evenly.
    """
    return missing.select(*KEYS, "seq").join(archive.select(*KEYS, "seq", "message"), KEYS + ["seq"], "left")


def number_lines(parsed: DataFrame) -> DataFrame:
    """Reply lines ``number^message`` as recovered rows; lines without a number are not messages."""
    n = F.substring_index("message", C.FIELD_SEP, 1)
    own = n.rlike("^-?[0-9]{1,19}$") & F.col("message").contains(C.FIELD_SEP)
    text = F.expr(f"substring(message, instr(message, '{C.FIELD_SEP}') + 1)")
    more = ["attempts"] if "attempts" in parsed.columns else []
    return parsed.where(own).select(*KEYS, n.try_cast("bigint").alias("seq"), text.alias("message"),
                                    F.lit("recovered").alias("source"), *more).where("seq is not null")


def backfill_ranges(ranges: DataFrame, archive: DataFrame) -> DataFrame:
    """B3 on ranges: the archive's rows for lost ``ranges`` (disjoint, per date), with no number written out.

    What the archive lacks stays a range: ``open_ranges(ranges, found)``.
    """
    return in_ranges(archive.select(*KEYS, "seq", "message"), ranges, KEYS)


def recovered_rows(backfilled: DataFrame) -> DataFrame:
    return backfilled.where(F.col("message").isNotNull()).select(*KEYS, "seq", "message", F.lit("recovered").alias("source"))


def still_missing(missing: DataFrame, recovered: DataFrame) -> DataFrame:
    """Lost numbers that no reply has filled yet."""
    return missing.select(*KEYS, "seq").join(recovered.select(*KEYS, "seq"), KEYS + ["seq"], "left_anti")


def open_ranges(ranges: DataFrame, recovered: DataFrame) -> DataFrame:
    """What is left of lost ranges (disjoint, per date) once the recovered numbers are taken out: ``lo, hi, n``.

    The ends of the ranges and the recovered numbers are points on one line;
    numbers are missing behind the start of a range or a recovered number, not
    behind the end of a range.  Where one range ends right before the next one
    starts, the two ends cancel out.
    """
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    marks = ranges.select(*KEYS, F.explode(ends).alias("p")).groupBy(*KEYS, F.col("p.at").alias("at")).agg(F.sum("p.d").alias("d"))
    opens = F.col("d") > 0
    points = marks.where("d <> 0").select(*KEYS, F.when(opens, F.col("at") - 1).otherwise(F.col("at")).alias("seq"), opens.alias("opens"))
    points = points.unionByName(recovered.select(*KEYS, "seq", F.lit(True).alias("opens")))
    points = points.groupBy(*KEYS, "seq").agg(F.max("opens").alias("opens"))
    return gap_ranges(points, opens="opens")


class Round(NamedTuple):
    """One round of requests: what was sent, what came back, what goes on."""

    sent: DataFrame                        # requests with ``parts`` and ``attempts``, this round's included
    recovered: DataFrame                   # rows read from the reply bodies, with the attempts of their request
    pending: DataFrame                     # requests without a good reply
    left: DataFrame                        # ranges that good replies did not fill


def recovery_round(ranges: DataFrame, pending: DataFrame | None, ask: Callable[[DataFrame], DataFrame],
                   batch_size: int = C.BATCH_SIZE) -> Round:
    """Ask for the lost ``ranges`` and, again, for what is ``pending``.

    ``ask`` sends requests and gives (channel, feed_date, lo, hi, body).  A
    request keeps its identity (channel, feed_date, lo, hi) until it is
    answered; its attempts are kept with it.  Numbers that a good reply lacks
    are in ``left``, to be asked for in the next round.
    """
    key = [*KEYS, "lo", "hi"]
    sent = request_batches(ranges, batch_size).withColumn("attempts", F.lit(0))
    if pending is not None:
        sent = sent.unionByName(pending.select(sent.columns))
    sent = materialize(sent.withColumn("attempts", (F.col("attempts") + 1).cast("int")), "requests")
    replies = materialize(ask(sent), "replies").select(*key, "body")
    good = replies.where(reply_ok(F.col("body")))
    lines = parse_replies(good, key).join(sent.select(*key, "attempts"), key)
    recovered = materialize(number_lines(lines), "recovered")
    waiting = materialize(sent.join(good.select(*key), key, "left_anti"), "pending")
    answered = sent.join(good.select(*key), key, "left_semi").select(*KEYS, F.explode("parts").alias("p"))
    left = open_ranges(answered.select(*KEYS, "p.lo", "p.hi"), recovered)
    return Round(sent, recovered, waiting, materialize(left, "left"))


def merge_feed(live: DataFrame, recovered: DataFrame) -> DataFrame:
    """Live and recovered rows in one feed (union all; a duplicate is delivered twice, as on the wire)."""
    lv = live.select(*KEYS, "seq", "message", F.lit("live").alias("source"))
    return lv.unionByName(recovered.select(*KEYS, "seq", "message", "source"))
