from pyspark.sql import functions as F

from feedspark import schemas
from feedspark.session import scratch_path
from feedspark.sinks import deliver as D
from feedspark.sources.delivered import DeliveredReader, ids_path, read_on


def _feed(spark, numbers):
    rows = spark.createDataFrame([(i,) for i in numbers], "seq long")
    cols = {"channel": F.lit("c"), "feed_date": F.lit("20240101"), "message": F.concat(F.lit("m"), "seq"), "source": F.lit("live")}
    return rows.withColumns(cols).select(*schemas.FEED.fieldNames())


def test_ids_go_on_without_reading_rows(spark):
    path = scratch_path(spark, "table")
    for batch, numbers in enumerate(([5, 6, 7], [], [1, 2], [9])):
        D.deliver_batch(_feed(spark, numbers), path, batch)
    D.deliver_batch(_feed(spark, [1, 2]), path, 2)                       # a replay
    got = {r.seq: r.id for r in D.read_delivered(spark, path).collect()}
    assert got == {5: 1, 6: 2, 7: 3, 1: 4, 2: 5, 9: 6}
    assert [tuple(r) for r in spark.read.parquet(ids_path(path)).orderBy("n").select("n", "first", "last").collect()] == [
        (-1, 1, 0), (0, 1, 3), (1, 4, 3), (2, 4, 5), (3, 6, 6)]


def test_a_consumer_goes_on_where_it_stopped(spark):
    path = scratch_path(spark, "table")
    got = {"one": [], "two": []}

    def run(who, position=0):
        def take(batch, _):
            got[who] += [r.id for r in batch.collect()]
        D.start_consumer(read_on(spark, path, position), take, f"{path}_ck_{who}").awaitTermination()

    D.deliver_batch(_feed(spark, range(40)), path, 0)
    run("one")
    D.deliver_batch(_feed(spark, []), path, 1)
    run("one")
    D.deliver_batch(_feed(spark, range(40, 100)), path, 2)
    run("one")
    run("two", 55)                                                       # its own position
    assert got == {"one": list(range(1, 101)), "two": list(range(56, 101))}


def test_parts_cut_batches_where_positions_say(spark):
    path = scratch_path(spark, "table")
    for batch in range(3):
        D.deliver_batch(_feed(spark, range(10 * batch, 10 * batch + 10)), path, batch)
    r = DeliveredReader({"path": path})
    assert r.initialOffset() == {"id": 0} and r.latestOffset() == {"id": 30}
    parts = r.partitions({"id": 4}, {"id": 25})
    assert [(p.batch, p.low, p.high) for p in parts] == [(0, 4, 10), (1, 10, 20), (2, 20, 25)]
    assert [i for p in parts for b in r.read(p) for i in b.column("id").to_pylist()] == list(range(5, 26))
    assert r.partitions({"id": 30}, {"id": 30}) == []
