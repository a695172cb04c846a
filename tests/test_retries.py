"""The retry stream: a clock, attempts, quiet feeds, replays and late numbers; subtraction of ranges."""

import random

from pyspark.sql import functions as F

from feedspark.operators.intervals import minus_ranges
from feedspark.session import scratch_path
from feedspark.streaming import recovery as SR
from feedspark.streaming import retries as RT
from feedspark.streaming.gaps import EVENTS

ARCHIVE = "channel string, feed_date string, seq long, message string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def test_minus_ranges(spark):
    rnd, a, b, want = random.Random(5), [], [], set()
    for k in range(40):
        for rows in (a, b):
            at = 0
            for _ in range(rnd.randint(0, 6)):
                lo = at + rnd.randint(0, 4)
                rows.append((k, lo, lo + rnd.randint(0, 5)))
                at = rows[-1][2] + 1
        own = {x for i, lo, hi in a if i == k for x in range(lo, hi + 1)}
        want |= {(k, x) for x in own - {x for i, lo, hi in b if i == k for x in range(lo, hi + 1)}}
    a += [(100, LOW, HIGH), (101, 3, 9), (102, 9, 3), (None, 1, 2)]
    b += [(100, 5, 6), (101, LOW, HIGH), (102, 1, 1), (103, 1, 2), (None, 2, 2)]
    schema = "k int, lo long, hi long"
    got = [tuple(r) for r in minus_ranges(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).collect()]
    assert sorted(r for r in got if r[0] in (100, 101, 102, 103)) == [(100, LOW, 4), (100, 7, HIGH)]
    assert [r for r in got if r[0] is None] == [(None, 1, 1)]
    small = [(k, x) for k, lo, hi in got if k is not None and k < 100 for x in range(lo, hi + 1)]
    assert len(small) == len(set(small)) and set(small) == want


def _land(spark, path, rows):
    spark.createDataFrame([("c", "D", 0, *r) for r in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)


def _asker(spark, known, busy, sent_log):
    """An archive that knows ``known[tick]`` and is busy for requests that hold a number of ``busy[tick]``."""

    def ask(sent, tick):
        rows = []
        for r in sent.orderBy("lo").collect():
            nums = [n for p in r.parts for n in range(p.lo, p.hi + 1)]
            sent_log.append((tick, nums, r.attempts))
            lines = "".join(f"\n{n}^m{n}" for n in nums if n in known[tick])
            rows.append((r.channel, r.feed_date, r.lo, r.hi, "Server busy" if set(nums) & busy[tick] else "Missed Packets:" + lines))
        return spark.createDataFrame(rows, "channel string, feed_date string, lo long, hi long, body string")

    return ask


def test_quiet_feed_is_asked_again_and_attempts_count(spark):
    events, out, ck = (scratch_path(spark, n) for n in ("ev", "out", "ck"))
    _land(spark, events, [("bounds", 1, 40), ("opened", 2, 4), ("opened", 10, 12)])
    log = []
    known = {0: {2, 3, 10}, 1: {2, 3, 10, 11}, 2: {2, 3, 4, 10, 11, 12}, 3: {21}}
    busy = {0: {10}, 1: {10}, 2: set(), 3: set()}
    ask = _asker(spark, known, busy, log)

    def go():
        RT.start_retries(spark, events, ask, out, ck, batch_size=3).awaitTermination()
        return sorted((r.seq, r.attempts, r.batch_id) for r in RT.read_answered(spark, out).collect())

    assert go() == [(2, 1, 0), (3, 1, 0)]
    assert [(r.lo, r.attempts) for r in RT.read_pending(spark, out, 0).collect()] == [(10, 1)]
    assert go() == [(2, 1, 0), (3, 1, 0)]                    # no event came in; both open requests were sent again
    assert go() == [(2, 1, 0), (3, 1, 0), (4, 1, 2), (10, 3, 2), (11, 3, 2), (12, 3, 2)]
    tick_2 = [x for x in log if x[0] == 2]
    assert [x[1:] for x in log if x[0] == 0] == [([2, 3, 4], 1), ([10, 11, 12], 1)]
    assert [x[1:] for x in log if x[0] == 1] == [([4], 1), ([10, 11, 12], 2)]
    assert [x[1:] for x in tick_2] == [([4], 1), ([10, 11, 12], 3)]
    _land(spark, events, [("opened", 20, 21)])               # a new gap of a date asked for before
    assert [x for x in go() if x[2] == 3] == [(21, 1, 3)]
    assert [x[1:] for x in log if x[0] == 3] == [([20, 21], 1)]


def test_replayed_tick_and_late_numbers(spark):
    events, out = scratch_path(spark, "ev"), scratch_path(spark, "out")
    _land(spark, events, [("bounds", 1, 40), ("opened", 3, 8)])
    log = []
    ask = _asker(spark, {0: {4}, 1: {3, 5, 7, 8}, 2: set()}, {0: set(), 1: set(), 2: set()}, log)
    dates = spark.createDataFrame([("c", "D")], "channel string, feed_date string")
    RT.prepare(spark, out)
    for _ in range(2):
        RT.retry(spark, events, ask, out, dates, 0)
    assert [r.seq for r in RT.read_answered(spark, out).collect()] == [4]
    # 4 comes late, after the archive gave it, and 5 and 6 with it
    _land(spark, events, [("closed", 3, 8), ("opened", 3, 3), ("opened", 7, 8)])
    for _ in range(2):
        RT.retry(spark, events, ask, out, dates, 1)
    assert sorted(r.seq for r in RT.read_answered(spark, out).collect()) == [3, 4, 7, 8]
    assert [x[1] for x in log if x[0] == 1] == [[3, 7, 8]] * 2
    RT.retry(spark, events, ask, out, dates.where("false"), 2)
    assert not [x for x in log if x[0] == 2]


def test_lookup_leaves_late_numbers_alone(spark):
    """The plain recovery query: a number that came late after its recovery opens nothing."""
    events, out = scratch_path(spark, "ev"), scratch_path(spark, "out")
    _land(spark, events, [("bounds", 1, 40), ("opened", 3, 8)])
    dates = spark.createDataFrame([("c", "D")], "channel string, feed_date string")
    archive = spark.createDataFrame([("c", "D", n, "m") for n in range(3, 9)], ARCHIVE)
    SR.prepare(spark, out)
    SR.recover(spark, events, archive.where("seq = 4"), out, dates, 0)
    _land(spark, events, [("closed", 3, 8), ("opened", 3, 3), ("opened", 7, 8)])
    SR.recover(spark, events, archive, out, dates, 1)
    assert sorted(r.seq for r in SR.read_recovered(spark, out).collect()) == [3, 4, 7, 8]


def test_clock_ticks_by_itself(spark):
    events, out, ck = (scratch_path(spark, n) for n in ("ev", "out", "ck"))
    _land(spark, events, [("bounds", 1, 9), ("opened", 2, 2)])
    log = []
    always = {t: {2} if t else set() for t in range(100)}
    q = RT.start_retries(spark, events, _asker(spark, always, {t: set() for t in range(100)}, log), out, ck,
                         available_now=False, period="1 second")
    try:
        for _ in range(120):
            if RT.read_answered(spark, out).where(F.col("seq") == 2).count():
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert [r.batch_id for r in RT.read_answered(spark, out).collect()] == [1]
