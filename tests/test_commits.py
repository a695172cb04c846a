import pytest
from pyspark.sql import types as T

from feedspark.session import scratch_path
from feedspark.sinks import commits as CM



def _struct(**kinds):
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


SCHEMA = _struct(id=T.LongType(), message=T.StringType(), seq=T.LongType())


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, message string, seq string")


def _state(spark, root):
    return (sorted(tuple(r) for r in CM.read_written(spark, root, SCHEMA).collect()),
            sorted((r.seq, r._reason) for r in CM.read_refused(spark, root, SCHEMA).collect()))


def test_a_batch_counts_once(spark):
    root = scratch_path(spark, "once")
    CM.create(spark, root)
    assert _state(spark, root) == ([], [])
    rows = _rows(spark, (1, "a", "7"), (2, None, "8"), (3, "c", "x"), (4, "a", "7"))

    def stop():
        raise ConnectionError

    with pytest.raises(ConnectionError):
        CM.append_once(rows, root, 0, SCHEMA, {"id", "message"}, stop)
    assert _state(spark, root) == ([], [])                   # neither good nor refused rows of an unfinished attempt
    want = ([(1, "a", 7), (4, "a", 7)], [("8", "message is null"), ("x", "seq is not bigint")])
    for _ in range(2):
        assert CM.append_once(rows, root, 0, SCHEMA, {"id", "message"}) == (2, 2)
        assert _state(spark, root) == want
    CM.create(spark, root)                                   # leaves a table as it is
    assert CM.append_once(rows.where("false"), root, 1, SCHEMA) == (0, 0)
    assert _state(spark, root) == want


def test_columns(spark):
    root = scratch_path(spark, "once")
    CM.create(spark, root)
    with pytest.raises(ValueError, match="lacks the columns attempt"):
        CM.append_once(spark.createDataFrame([(1, "x")], "id bigint, attempt string"), root, 0, SCHEMA)
    assert CM.append_once(spark.createDataFrame([(1,)], "ID int"), root, 0, SCHEMA, {"message"}) == (0, 1)
    assert CM.append_once(spark.createDataFrame([(1,)], "ID int"), root, 1, SCHEMA) == (1, 0)
    assert _state(spark, root) == ([(1, None, None)], [(None, "message is null")])
    clash = _struct(reason=T.StringType(), refused=T.StringType(), row=T.LongType(), raw=T.LongType())
    other = scratch_path(spark, "once")
    CM.create(spark, other)
    CM.append_once(spark.createDataFrame([("r", "f", 1, 2)], "reason string, refused string, row int, raw int"), other, 0, clash)
    assert [tuple(r) for r in CM.read_written(spark, other, clash).collect()] == [("r", "f", 1, 2)]


def test_of_two_records_one_holds(spark):
    root = scratch_path(spark, "once")
    CM.create(spark, root)
    rows = _rows(spark, (1, "a", "7"))
    CM.append_once(rows, root, 0, SCHEMA, before_commit=lambda: CM.append_once(rows, root, 0, SCHEMA))
    assert CM.commits(spark, root).count() == 1
    assert _state(spark, root) == ([(1, "a", 7)], [])


def test_a_stream_appends_once(spark):
    src, root, ck = (scratch_path(spark, n) for n in ("src", "once", "ck"))
    for i in range(3):
        _rows(spark, (i, "m", str(i)), (i, None, "0")).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("id bigint, message string, seq string").option("maxFilesPerTrigger", 1).parquet(src)
        CM.start_append(stream, root, ck, SCHEMA, {"message"}).awaitTermination()
    assert _state(spark, root) == ([(i, "m", i) for i in range(3)], [("0", "message is null")] * 3)
