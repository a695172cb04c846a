import random

import numpy as np

from feedspark import schemas
from feedspark.operators import loss as L
from feedspark.session import scratch_path
from feedspark.streaming import gaps as SG
from feedspark.streaming.gate import start_gaps


def _fold_local(batches):
    mn = mx = None
    los = his = np.zeros(0, np.int64)
    opened, closed = [], []
    for b in batches:
        mn, mx, los, his, olo, ohi, clo, chi = SG.absorb(mn, mx, los, his, np.asarray(b, np.int64))
        opened += list(zip(olo.tolist(), ohi.tolist()))
        closed += list(zip(clo.tolist(), chi.tolist()))
    return mn, mx, list(zip(los.tolist(), his.tolist())), opened, closed


def test_absorb_examples():
    mn, mx, open_, _, _ = _fold_local([[1, 2, 3, 4, 7], [9, 10, 11]])
    assert open_ == [(5, 6), (8, 8)]
    mn, mx, open_, opened, closed = _fold_local([[5, 9], [7]])
    assert open_ == [(6, 6), (8, 8)] and (6, 8) in opened and (6, 8) in closed
    _, _, open_, _, _ = _fold_local([[4], [4, 4]])
    assert open_ == []
    _, _, open_, _, _ = _fold_local([[10], [3], [20, 1]])
    assert open_ == [(2, 2), (4, 9), (11, 19)]


def test_absorb_random_orders_equal_set_difference():
    rnd = random.Random(5)
    for _ in range(30):
        nums = [rnd.randint(0, 200) for _ in range(rnd.randint(1, 150))]
        rnd.shuffle(nums)
        k = rnd.randint(1, 6)
        batches = [nums[i::k] for i in range(k)]
        _, _, open_, _, _ = _fold_local(batches)
        got = sorted(x for lo, hi in open_ for x in range(lo, hi + 1))
        s = set(nums)
        assert got == sorted(x for x in range(min(s), max(s) + 1) if x not in s)


def test_stream_equals_batch(spark):
    rnd = random.Random(9)
    rows = [("c", rnd.choice(["20240101", "20240102"]), rnd.randint(0, 5000), "m", None, 0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "channel string, feed_date string, seq bigint, message string, "
                                     "arrival_ts timestamp_ntz, extra_fields int")
    src = scratch_path(spark, "pk")
    df.repartition(5).write.parquet(src)
    stream = spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "ev")
    # a narrow bucket so gaps straddle state keys
    q = (SG.gap_events(stream, width=256).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(q.recentProgress) >= 5
    got = sorted(tuple(r) for r in SG.missing_from_events(spark.read.schema(SG.EVENTS).parquet(out)).collect())
    want = sorted(tuple(r) for r in L.gaps(df).collect())
    assert got == want
    assert start_gaps  # public entry point exists


def test_key_fold_stream_equals_batch(spark):
    import base64
    import datetime as dt

    from feedspark.operators.keys import fold_replies
    from feedspark.streaming import keys as SK

    def enc(text: bytes, key: bytes) -> str:
        return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()

    boot, t0 = b"boot-key-x", dt.datetime(2024, 1, 1)
    rows, key = [], boot
    for i in range(12):
        if i in (4, 7):  # malformed replies keep the state
            rows.append(("c", i, t0 + dt.timedelta(hours=i), enc(b"only^two", key)))
            continue
        c = f"ci{i:02d}".encode()
        rows.append(("c", i, t0 + dt.timedelta(hours=i), enc(c + b"^sec" + str(i).encode() + b"^60", key)))
        key = c
    df = spark.createDataFrame(rows, "channel string, ord int, arrival_ts timestamp_ntz, wire string")
    landed = SK.land_replies(df, scratch_path(spark, "rep"), files=4)
    out = scratch_path(spark, "fold")
    q = (SK.fold_stream(SK.read_replies_stream(spark, landed)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(q.recentProgress) == 4
    got = sorted(tuple(r) for r in spark.read.schema(schemas.KEY_FOLD).parquet(out).collect())
    want = sorted(tuple(r) for r in fold_replies(df).collect())
    assert got == want
    assert [r[3] for r in got].count(False) == 2


def test_retention_drops_old_dates_from_tracking(spark):
    import datetime as dt
    import time

    t0 = dt.datetime(2024, 1, 1)
    batches = [
        [("c", "A", s, "m", t0 + dt.timedelta(minutes=s), 0) for s in (1, 2, 5)],
        [("c", "B", s, "m", t0 + dt.timedelta(days=3, minutes=s), 0) for s in (1, 4)],
        [("c", "B", 9, "m", t0 + dt.timedelta(days=3, minutes=9), 0)],
        # late packets: A's 3 after A left tracking, B's 2 within the retention period
        [("c", "A", 3, "m", t0 + dt.timedelta(minutes=3), 0), ("c", "B", 2, "m", t0 + dt.timedelta(days=3, minutes=2), 0)],
    ]
    src = scratch_path(spark, "pk")
    for b in batches:
        spark.createDataFrame(b, schemas.PACKETS).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "ev")
    q = (SG.gap_events(stream, retention_s=86400).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.feed_date, r.seq) for r in SG.missing_from_events(spark.read.schema(SG.EVENTS).parquet(out)).collect())
    assert [r.feed_date for r in spark.read.schema(SG.EVENTS).parquet(out).where("kind = 'evicted'").collect()] == ["A"]
    # A: 3 and 4 stay missing (3 arrived after tracking ended); B: 2 healed, 3, 5-8 missing
    assert got == [("A", 3), ("A", 4), ("B", 3), ("B", 5), ("B", 6), ("B", 7), ("B", 8)]


def test_recovery_retries_open_ranges_and_survives_replays(spark):
    from feedspark.streaming import recovery as SR

    ev_path, out = scratch_path(spark, "ev"), scratch_path(spark, "rec")
    events = spark.createDataFrame(
        [("c", "D", 0, "opened", 3, 5), ("c", "D", 0, "opened", 7, 8), ("c", "D", 0, "bounds", 1, 9)], SG.EVENTS)
    events.write.partitionBy("feed_date").parquet(ev_path)
    archive = spark.createDataFrame([("c", "D", s, f"m{s}") for s in range(1, 10) if s != 4],
                                    "channel string, feed_date string, seq bigint, message string")
    SR.prepare(spark, out)
    got = lambda: sorted(r.seq for r in SR.read_recovered(spark, out).collect())
    SR.recover(spark, ev_path, archive, out, events, 0)
    SR.recover(spark, ev_path, archive, out, events, 0)  # the same batch replayed after a failure
    assert got() == [3, 5, 7, 8]
    SR.recover(spark, ev_path, archive, out, events, 1)  # nothing new to recover
    assert got() == [3, 5, 7, 8]
    late = archive.unionByName(spark.createDataFrame([("c", "D", 4, "m4")], archive.schema))
    SR.recover(spark, ev_path, late, out, events.where("false"), 2)  # no new gap events, but the archive has more
    assert got() == [3, 4, 5, 7, 8]


def test_lost_reply_does_not_stall_the_channel(spark):
    import base64
    import datetime as dt

    from feedspark.streaming import keys as SK

    enc = lambda text, key: base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()
    t0, boot = dt.datetime(2024, 1, 1), b"boot-key-x"
    rows = [("c", 0, t0, enc(b"k0^s0^60", boot)), ("c", 2, t0 + dt.timedelta(hours=2), enc(b"k2^s2^60", b"k0")),
            ("c", 3, t0 + dt.timedelta(hours=30), enc(b"k3^s3^60", b"k2"))]
    path, out = scratch_path(spark, "rep"), scratch_path(spark, "fold")
    df = spark.createDataFrame(rows, "channel string, ord int, arrival_ts timestamp_ntz, wire string")
    SK.land_replies(df, path, files=4)
    q = (SK.fold_stream(SK.read_replies_stream(spark, path), wait_s=86400).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.ord: (r.ok, r.cipher) for r in spark.read.schema(schemas.KEY_FOLD).parquet(out).collect()}
    assert got == {0: (True, "k0"), 1: (False, None), 2: (True, "k2"), 3: (True, "k3")}


def test_gate_holds_packets_for_keys_that_come_later(spark):
    import base64
    import datetime as dt

    from feedspark.streaming import gate as G

    enc = lambda text, key: base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()
    t0, hour, ciphers = dt.datetime(2024, 1, 1), dt.timedelta(hours=1), ["alphaalpha", "bravobravo", "charliecha"]

    def fold(epoch):
        return ("c", epoch, t0 + epoch * hour, True, epoch, ciphers[epoch], f"secret{epoch:04d}", 60, None, None)

    def packet(epoch, n):
        return (t0 + epoch * hour + dt.timedelta(minutes=n), "c", enc(f"secret{epoch:04d}^20240101^{n}^m".encode(), ciphers[epoch].encode()))

    folds, out = scratch_path(spark, "fold"), scratch_path(spark, "gate")
    spark.createDataFrame([fold(0)], schemas.KEY_FOLD).write.parquet(folds)
    wire, ck = scratch_path(spark, "wire"), scratch_path(spark, "ck")

    def go(rows):
        G.land_wire(spark.createDataFrame(rows, schemas.WIRE), wire, 1)
        G.start_gate(G.read_wire_stream(spark, wire), folds, out, ck).awaitTermination()
        return (sorted(r.seq for r in G.read_packets(spark, out).collect()), G.read_waiting(spark, out).count(),
                sorted(r.reason for r in G.read_rejected(spark, out).collect()))

    bad = (t0 + dt.timedelta(minutes=30), "c", enc(b"nosecret00^20240101^9^m", ciphers[0].encode()))
    assert go([packet(0, 1), packet(1, 2), bad]) == ([1], 2, [])
    assert go([packet(2, 3)]) == ([1], 3, [])
    spark.createDataFrame([fold(1)], schemas.KEY_FOLD).write.mode("append").parquet(folds)
    assert go([packet(1, 4)]) == ([1, 2, 4], 1, ["bad_secret"])
    spark.createDataFrame([fold(2)], schemas.KEY_FOLD).write.mode("append").parquet(folds)
    last = G.last_batch(spark, out)
    for _ in range(2):  # the second is a replay
        G.gate_batch(spark, folds, out)(spark.createDataFrame([packet(2, 5)], schemas.WIRE), last + 1)
    assert sorted(r.seq for r in G.read_packets(spark, out).collect()) == [1, 2, 3, 4, 5]
    counts = {r.outcome: r.packets for r in G.gate_counts(spark, out).collect()}
    assert counts == {"passed": 5, "bad_secret": 1}


def test_key_fold_stream_out_of_order_files(spark):
    import base64
    import datetime as dt
    import time

    from feedspark.operators.keys import fold_replies
    from feedspark.streaming import keys as SK

    def enc(text: bytes, key: bytes) -> str:
        return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()

    t0, key, rows = dt.datetime(2024, 1, 1), b"boot-key-x", []
    for i in range(9):
        c = f"kk{i:02d}".encode()
        rows.append(("c", i, t0 + dt.timedelta(hours=i), enc(c + b"^sec" + str(i).encode() + b"^60", key)))
        key = c
    df = spark.createDataFrame(rows, "channel string, ord int, arrival_ts timestamp_ntz, wire string")
    path = scratch_path(spark, "rep")
    for lo, hi in ((6, 9), (0, 3), (3, 6), (0, 3)):  # later numbers first, then a replayed file
        df.where(f"ord >= {lo} AND ord < {hi}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    out = scratch_path(spark, "fold")
    q = SK.start_fold(SK.read_replies_stream(spark, path), out, scratch_path(spark, "ck"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(schemas.KEY_FOLD).parquet(out).collect())
    assert got == sorted(tuple(r) for r in fold_replies(df).collect())


def test_a_late_number_writes_little_state(spark):
    import time

    src, out = scratch_path(spark, "pk"), scratch_path(spark, "ev")

    def land(nums):
        rows = [("c", "D", n, "m", None, 0) for n in nums]
        spark.createDataFrame(rows, schemas.PACKETS).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)

    land(range(0, 60_000, 2))                                # 30,000 open ranges
    land([301])
    land([70_001, 60_000, 40_001])
    stream = spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", 1).parquet(src)
    q = (SG.gap_events(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    written = [sum(s.numRowsUpdated for s in p.stateOperators) for p in q.recentProgress if p.numInputRows]
    assert len(written) == 3 and written[0] < 300 and max(written[1:]) <= 6
    got = SG.fold_gap_events(spark.read.schema(SG.EVENTS).parquet(out))
    want = [(n, n) for n in range(1, 59_998, 2) if n not in (301, 40_001)] + [(59_999, 59_999), (60_001, 70_000)]
    assert sorted((r.lo, r.hi) for r in got.collect()) == want


def test_range_map_random():
    rnd = random.Random(3)

    class State(dict):
        updateValue, removeKey = dict.__setitem__, dict.__delitem__
        getValue = dict.get

    for _ in range(60):
        first, width, state, used, mn, mx = rnd.choice([0, -4096, 8192]), 4096, State(), b"", None, None
        seen = set()
        for _ in range(rnd.randint(1, 12)):
            nums = np.unique([first + rnd.randint(0, width - 1) for _ in range(rnd.choice([1, 2, 40, 900]))])
            ranges = SG.RangeMap(state, first, used)
            los, his = ranges.near(nums)
            mn, mx, los, his, *_ = SG.absorb(mn, mx, los, his, nums)
            used = ranges.store(los, his)
            seen |= set(nums.tolist())
            pairs = sorted(p for v in state.values() for p in zip(*v))
            got = [x for lo, hi in pairs for x in range(lo, hi + 1)]
            assert got == [x for x in range(min(seen), max(seen) + 1) if x not in seen]
            assert all(hi + 1 in seen and lo - 1 in seen for lo, hi in pairs)
