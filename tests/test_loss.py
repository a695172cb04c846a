import random

from pyspark.sql import functions as F

from feedspark.operators import loss as L


def _nums(spark, pairs):
    return spark.createDataFrame([("c", d, s) for d, s in pairs], "channel string, feed_date string, seq bigint")


def _brute(pairs):
    by = {}
    for d, s in pairs:
        by.setdefault(d, set()).add(s)
    return sorted(("c", d, x) for d, ss in by.items() for x in range(min(ss), max(ss) + 1) if x not in ss)


def test_gap_examples(spark):
    pairs = [("A", s) for s in (1, 2, 3, 4, 7, 9, 10, 11, 9, 9)] + [("B", 5)]
    got = sorted(tuple(r) for r in L.gaps(_nums(spark, pairs)).collect())
    assert got == [("c", "A", 5), ("c", "A", 6), ("c", "A", 8)]


def test_two_level_equals_brute_force(spark):
    rnd = random.Random(7)
    pairs = [(rnd.choice("ABC"), rnd.randint(0, 3000)) for _ in range(2500)]
    df = _nums(spark, pairs)
    for width in (1, 16, 1000, 1 << 20):
        got = sorted(tuple(r) for r in L.gaps(df, width=width).collect())
        assert got == _brute(pairs), width


def test_wide_range_is_chunked(spark):
    pairs = [("A", 0), ("A", 100_001), ("A", 100_003)]
    got = L.expand_ranges(L.gap_ranges(_nums(spark, pairs)), chunk=1000)
    assert got.count() == 100_001
    assert got.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first() == (1, 100_002, 100_001)


def test_summary_counts_duplicates(spark):
    pairs = [("A", s) for s in (1, 1, 2, 5)]
    r = L.loss_summary(_nums(spark, pairs), width=2).first()
    assert (r.received, r.distinct_numbers, r.duplicates, r.first_seq, r.last_seq, r.lost) == (4, 3, 1, 1, 5, 2)


def test_live_dates(spark):
    rows = [("c", "A", "2024-01-01 00:00:00"), ("c", "B", "2024-01-02 00:00:00"), ("c", "C", "2024-01-03 00:00:00"),
            ("c", "A", "2024-01-04 00:00:00")]
    df = spark.createDataFrame(rows, "channel string, feed_date string, ts string").select(
        "channel", "feed_date", F.to_timestamp_ntz("ts").alias("arrival_ts"))
    got = {r.feed_date: r.tracked for r in L.live_dates(df).collect()}
    assert got == {"A": False, "B": True, "C": True}


def test_jumps_and_the_ends_of_bigint(spark):
    lo, hi = -(1 << 63), (1 << 63) - 1
    r = L.gap_ranges(_nums(spark, [("A", lo), ("A", hi), ("B", 5), ("B", 5 + 10 ** 15)])).collect()
    got = {x.feed_date: (x.lo, x.hi, int(x.n)) for x in r}
    assert got == {"A": (lo + 1, hi - 1, (1 << 64) - 2), "B": (6, 4 + 10 ** 15, 10 ** 15 - 1)}
    few = L.expand_ranges(L.gap_ranges(_nums(spark, [("A", hi - 5), ("A", hi)])))
    assert sorted(x.seq for x in few.collect()) == [hi - 4, hi - 3, hi - 2, hi - 1]
    s = L.loss_summary(_nums(spark, [("A", lo), ("A", hi)])).first()
    assert int(s.lost) == (1 << 64) - 2


def test_only_what_follows_an_opening_number_is_lost(spark):
    rows = [("c", "A", 1, True), ("c", "A", 5, False), ("c", "A", 9, True), ("c", "A", 10, False), ("c", "A", 400, True), ("c", "A", 900, False)]
    df = spark.createDataFrame(rows, "channel string, feed_date string, seq bigint, o boolean")
    for width in (3, 100, 1 << 17):
        assert sorted((x.lo, x.hi) for x in L.gap_ranges(df, width=width, opens="o").collect()) == [(2, 4), (401, 899)]


def test_tracked_dates_only(spark):
    rows = [("c", d, s, f"2024-01-0{i} 00:00:00") for i, d in ((1, "A"), (2, "B"), (3, "C")) for s in (1, 3)]
    df = spark.createDataFrame(rows, "channel string, feed_date string, seq bigint, ts string").select(
        "channel", "feed_date", "seq", F.to_timestamp_ntz("ts").alias("arrival_ts"))
    assert sorted((x.feed_date, x.seq) for x in L.gaps(L.tracked(df)).collect()) == [("B", 2), ("C", 2)]


def test_date_status_against_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), f"d{rng.randrange(5)}", i // 2, rng.choice([None] + [t0 + dt.timedelta(minutes=rng.randrange(60))] * 9)) for i in range(300)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "channel string, feed_date string, seq long, arrival_ts timestamp_ntz").repartition(4)
    out = L.date_status(df)
    want = []
    for ch in "ab":
        known = []
        own = sorted((r for r in rows if r[0] == ch), key=lambda r: (r[3] is not None, r[3] or t0, r[2], r[1]))
        for k, r in enumerate(own):
            if r[1] not in known:
                known.append(r[1])
                status = "new"
            elif own[k - 1] == r and want[-1][0] == r and want[-1][2] == "new":
                status = "new"                                        # an equal row came at once
            else:
                at = len(known) - known.index(r[1])
                status = "next" if at == 1 and len(known) > 1 else "current" if at <= 2 else "late"
            want.append((r, len(known), status))
    got = [((r.channel, r.feed_date, r.seq, r.arrival_ts), r.dates_seen, r.date_status) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert L.date_status(df.where("false")).count() == 0
