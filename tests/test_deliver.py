from feedspark import schemas
from feedspark.operators.framing import join_frames
from feedspark.session import scratch_path
from feedspark.sinks import deliver as D


def _feed(spark):
    rows = [("c", f"2024010{1 + i % 2}", i, "m" * (i * 300), "live") for i in range(8)]
    return spark.createDataFrame(rows, "channel string, feed_date string, seq bigint, message string, source string")


def test_consume_in_feed_order(spark, tmp_path):
    out = str(tmp_path)

    def keep(rows):
        import os
        import uuid

        rows = [(r.feed_date, r.seq) for r in rows]
        if rows:
            with open(os.path.join(out, uuid.uuid4().hex), "w") as f:
                f.write(repr(rows))

    D.consume(_feed(spark), keep)
    runs = sorted(eval(p.read_text()) for p in tmp_path.iterdir())
    flat = [x for run in runs for x in run]
    assert len(flat) == 8 and flat == sorted(flat)


def test_deliver_frames_and_table(spark):
    feed = _feed(spark)
    path = scratch_path(spark, "frames")
    D.deliver(feed, "frames", path=path)
    frames = spark.read.parquet(path)
    back = join_frames(frames).orderBy("msg_id").collect()
    want = sorted(((r.feed_date, r.seq), r.message) for r in feed.collect())
    assert [r.message for r in back] == [m for _, m in want]
    tpath = scratch_path(spark, "tbl")
    D.deliver(feed, "table", path=tpath)
    assert sorted(r.id for r in spark.read.parquet(tpath).collect()) == list(range(1, 9))


def test_ids_go_on_over_deliveries_and_replays(spark):
    path = scratch_path(spark, "tbl")
    for _ in range(3):
        D.deliver(_feed(spark), "table", path=path)
    assert sorted(r.id for r in D.read_delivered(spark, path).collect()) == list(range(1, 25))
    before = sorted(map(str, D.read_delivered(spark, path).collect()))
    D.deliver_batch(_feed(spark), path, 2)
    assert sorted(map(str, D.read_delivered(spark, path).collect())) == before


def test_consumer_programs_and_streamed_delivery(spark):
    src, path = scratch_path(spark, "feed"), scratch_path(spark, "tbl")
    _feed(spark).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(schemas.FEED).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    D.start_consumer(stream, lambda df, i: seen.append(df.count()), scratch_path(spark, "ck")).awaitTermination()
    assert sum(seen) == 8 and len(seen) == 3
    D.start_delivery(stream, path, scratch_path(spark, "ck")).awaitTermination()
    rows = D.read_delivered(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1, 9)) and sorted(r.seq for r in rows) == list(range(8))
