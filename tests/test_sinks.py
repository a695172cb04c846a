import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedspark.session import scratch_path
from feedspark.sinks import audit as A
from feedspark.sinks import tables as S


def _feed(spark, n=50):
    rows = [("c", f"2024010{1 + i % 3}", i, f"m{i}", "live") for i in range(n)]
    return spark.createDataFrame(rows, "channel string, feed_date string, seq bigint, message string, source string")


def test_serial_ids_dense_in_feed_order(spark):
    got = S.with_ids(_feed(spark)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 51))
    keys = [(r.channel, r.feed_date, r.seq) for r in got]
    assert keys == sorted(keys)


def _name(spark):
    return "t_" + scratch_path(spark, "x").rsplit("-", 1)[1]


def test_preflight_create_then_add_column(spark):
    name = _name(spark)
    assert S.preflight(spark, name, "message", location=scratch_path(spark, name))
    assert [f.name for f in spark.table(name).schema] == ["id", "message"]
    more = {"channel": "STRING", "feed_date": "STRING", "seq": "BIGINT", "source": "STRING"}
    assert S.preflight(spark, name, "message", extra_columns=more)
    S.append_table(S.with_ids(_feed(spark, 5)), name)
    assert sorted((r.seq, r.message, r.source) for r in spark.table(name).collect()) == [(i, f"m{i}", "live") for i in range(5)]
    assert S.required_columns(spark, name) == ["id", "message"]


def test_preflight_says_why_not(spark):
    bad = S.preflight(spark, "bad name;", "message")
    assert not bad and "bad identifier" in bad.reason
    name = _name(spark)
    spark.sql(f"CREATE TABLE {name} (id STRING, message STRING) USING parquet LOCATION '{scratch_path(spark, name)}'")
    bad = S.preflight(spark, name, "message")
    assert not bad and bad.reason == "id is string, not bigint"


def test_append_never_drops_a_column(spark):
    name = _name(spark)
    assert S.preflight(spark, name, "message", location=scratch_path(spark, name))
    with pytest.raises(ValueError, match="channel, feed_date, seq, source"):
        S.append_table(S.with_ids(_feed(spark, 5)), name)
    assert spark.table(name).count() == 0


def test_refused_rows_go_aside(spark):
    name, aside = _name(spark), scratch_path(spark, "refused")
    assert S.preflight(spark, name, "message", scratch_path(spark, name), {"seq": "BIGINT"})
    rows = spark.createDataFrame([(1, "a", "7"), (2, None, "8"), (3, "c", "x"), (None, None, None)], "id bigint, message string, seq string")
    assert S.append_checked(rows, name, aside) == (1, 3)
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, "a", 7)]
    assert {(r.id, r.reason) for r in spark.read.parquet(aside).collect()} == {
        (2, "message is null"), (3, "seq is not bigint"), (None, "id is null; message is null")}


def test_audit_line_format(spark):
    ts = dt.datetime(2024, 3, 9, 15, 4, 5)
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    line = df.select(A.audit_line(F.lit("INFO"), F.col("ts"), F.lit("hello")).alias("l")).first().l
    assert line == "INFO: 09/03/24->03:04:05 hello"


def test_quarantine_and_audit_writers(spark):
    rows = [(dt.datetime(2024, 1, 1, 1), "c", "w1", "oversize"), (dt.datetime(2024, 1, 2, 1), "c", "w2", "bad_secret")]
    rej = spark.createDataFrame(rows, "arrival_ts timestamp_ntz, channel string, wire string, reason string")
    qp = scratch_path(spark, "q")
    S.write_quarantine(rej, qp)
    S.write_quarantine(rej, qp)
    back = spark.read.parquet(qp)
    assert back.count() == 4 and {r.reason for r in back.collect()} == {"oversize", "bad_secret"}
    ap = scratch_path(spark, "a")
    lines = rej.select(A.audit_line(F.lit("ERROR"), F.col("arrival_ts"), F.col("reason")).alias("line"))
    A.append_audit(lines, ap)
    got = sorted(r.value for r in spark.read.text(ap).collect())
    assert got == ["ERROR: 01/01/24->01:00:00 oversize", "ERROR: 02/01/24->01:00:00 bad_secret"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from feedspark.session import scratch_root

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())
