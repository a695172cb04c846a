"""Audit log (S10): ``LEVEL: dd/mm/yy->hh:mm:ss text`` lines from gate and loss counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import audit_time
from feedspark.operators import packets as P


def audit_line(level, ts, text):
    return F.concat(level, F.lit(": "), audit_time(ts), F.lit(" "), text)


def audit_rows(parsed: DataFrame, summary: DataFrame, packets: DataFrame) -> DataFrame:
    """One ERROR row per (channel, gate failure kind) and one INFO/WARN row per (channel, date).

    ``summary`` is ``loss_summary(packets)``; the time of a row is the last
    arrival it covers.
    """
    failed = parsed.where(~F.col("status").isin(P.PASSED_CURRENT, P.PASSED_PREVIOUS))
    g = failed.groupBy("channel", "status").agg(F.max("arrival_ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    gate = g.select(
        F.col("ts"),
        F.lit("ERROR").alias("level"),
        F.concat(F.lit("channel "), F.col("channel"), F.lit(": "), F.col("n").cast("string"), F.lit(" packets "),
                 F.col("status")).alias("text"),
    )
    last = packets.groupBy("channel", "feed_date").agg(F.max("arrival_ts").alias("ts"))
    s = summary.join(last, ["channel", "feed_date"])
    loss = s.select(
        F.col("ts"),
        F.when(F.col("lost") > 0, F.lit("WARN")).otherwise(F.lit("INFO")).alias("level"),
        F.concat(F.lit("channel "), F.col("channel"), F.lit(" date "), F.col("feed_date"), F.lit(": "),
                 F.col("distinct_numbers").cast("string"), F.lit(" received, "), F.col("lost").cast("string"),
                 F.lit(" lost")).alias("text"),
    )
    rows = gate.unionByName(loss)
    return rows.withColumn("line", audit_line(F.col("level"), F.col("ts"), F.col("text")))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append the audit lines as text files (one line per row)."""
    rows.select("line").write.mode("append").text(path)
