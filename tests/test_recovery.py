import base64
from decimal import Decimal

from pyspark.sql import functions as F

from feedspark.operators import recovery as R


RANGES = "channel string, feed_date string, lo bigint, hi bigint, n decimal(20,0)"


def _ranges(spark, rows):
    return spark.createDataFrame([("c", d, lo, hi, Decimal(hi - lo + 1)) for d, lo, hi in rows], RANGES)


def test_request_batches(spark):
    sizes = [9, 10, 11, 21]
    rows = [(f"d{i}", 100, 99 + n) for i, n in enumerate(sizes)] + [("e", 1, 3), ("e", 7, 7), ("e", 20, 40)]
    req = R.request_batches(_ranges(spark, rows)).collect()
    per = {}
    for r in req:
        per.setdefault(r.feed_date, []).append(r)
    assert {d: len(v) for d, v in per.items()} == {"d0": 1, "d1": 1, "d2": 2, "d3": 3, "e": 3}
    for d, v in per.items():
        nums = []
        for r in sorted(v, key=lambda r: r.batch_no):
            text = base64.b64decode(r.missed_b64).decode()
            assert not text.startswith("^") and not text.endswith("^")
            own = [int(x) for x in text.split("^")]
            assert len(own) == r.n <= 10 and (r.lo, r.hi) == (own[0], own[-1])
            nums += own
            assert base64.b64decode(r.date_b64).decode() == d
        assert nums == sorted(nums) and len(nums) == len(set(nums))
    assert sum(r.n for r in req) == 51 + 25
    asg = {(r.feed_date, r.seq): r.batch_no for r in R.assign_batches(_ranges(spark, rows)).collect()}
    assert asg["e", 7] == 0 and asg["e", 25] == 0 and asg["e", 26] == 1 and len(asg) == 76


def test_request_counts_of_a_huge_jump(spark):
    got = R.request_counts(_ranges(spark, [("d", 5, 10 ** 15), ("d", 10 ** 16, 10 ** 16 + 2)])).first()
    assert (int(got.lost), int(got.requests)) == (10 ** 15 - 1, 10 ** 14)


def test_open_ranges(spark):
    ranges = _ranges(spark, [("d", 1, 5), ("d", 7, 7), ("d", 300000, 300004), ("e", 1, 2), ("f", 10, 10 ** 12)])
    rec = spark.createDataFrame([("c", "d", 3), ("c", "d", 7), ("c", "d", 300004), ("c", "e", 1), ("c", "e", 2), ("c", "f", 10), ("c", "f", 5000)],
                                "channel string, feed_date string, seq bigint")
    got = sorted((r.feed_date, r.lo, r.hi) for r in R.open_ranges(ranges, rec).collect())
    assert got == [("d", 1, 2), ("d", 4, 5), ("d", 300000, 300003), ("f", 11, 4999), ("f", 5001, 10 ** 12)]
    touching = _ranges(spark, [("d", 1, 5), ("d", 6, 9), ("d", 11, 12)])
    one = rec.where("seq = 3")
    assert sorted((r.lo, r.hi) for r in R.open_ranges(touching, one).where("feed_date = 'd'").collect()) == [(1, 2), (4, 9), (11, 12)]


def test_rounds_keep_attempts_and_retry_what_was_not_found(spark):
    ranges = _ranges(spark, [("d", 100, 119)])

    def answer(first):
        def ask(req):
            busy = (F.col("lo") == 110) & (F.col("attempts") < 3)
            found = F.array_join(F.transform(F.filter(F.flatten(F.transform("parts", lambda p: F.sequence(p["lo"], p["hi"]))),
                                                      lambda s: (s % 2 == 0) | F.lit(not first)),
                                             lambda s: F.concat(s.cast("string"), F.lit("^m"))), "\n")
            return req.select("channel", "feed_date", "lo", "hi", F.when(busy, "Server busy").otherwise(
                F.concat(F.lit("Missed Packets:\n"), found)).alias("body"))
        return ask

    one = R.recovery_round(ranges, None, answer(True))
    assert sorted((r.seq, r.attempts) for r in one.recovered.collect()) == [(s, 1) for s in range(100, 110, 2)]
    assert [(r.lo, r.attempts) for r in one.pending.collect()] == [(110, 1)]
    two = R.recovery_round(one.left, one.pending, answer(False))
    assert sorted((r.seq, r.attempts) for r in two.recovered.collect()) == [(s, 1) for s in range(101, 110, 2)]
    assert [(r.lo, r.attempts) for r in two.pending.collect()] == [(110, 2)] and two.left.count() == 0
    three = R.recovery_round(two.left, two.pending, answer(False))
    assert sorted((r.seq, r.attempts) for r in three.recovered.collect()) == [(s, 3) for s in range(110, 120)]
    assert three.pending.count() == 0


def test_reply_lines_with_numbers(spark):
    rows = [("c", "d", "5^hello^x"), ("c", "d", "no number"), ("c", "d", "^x"), ("c", "d", "99999999999999999999^y"), ("c", "d", "6^")]
    df = spark.createDataFrame(rows, "channel string, feed_date string, message string")
    assert sorted((r.seq, r.message) for r in R.number_lines(df).collect()) == [(5, "hello^x"), (6, "")]


def test_reply_parse(spark):
    rows = [(1, "Missed Packets:\nA\nB\n"), (2, "Server error"), (3, "Missed Packets:"), (4, "Missed Packets:\n"),
            (5, "Missed Packets:\nX\n\nY"), (6, None)]
    df = spark.createDataFrame(rows, "batch_no int, body string")
    got = R.parse_replies(df, key_cols=["batch_no"]).collect()
    assert [(r.batch_no, r.line_no, r.message) for r in got] == [
        (1, 0, "A"), (1, 1, "B"), (5, 0, "X"), (5, 1, ""), (5, 2, "Y")]


def test_backfill_and_still_missing(spark):
    miss = spark.createDataFrame([("c", "d", s) for s in range(100, 112)], "channel string, feed_date string, seq bigint")
    arch = miss.where(F.col("seq") % 2 == 0).withColumn("message", F.concat(F.lit("m"), F.col("seq").cast("string")))
    rec = R.recovered_rows(R.backfill(miss, arch))
    assert sorted(r.seq for r in rec.collect()) == list(range(100, 112, 2))
    assert sorted(r.seq for r in R.still_missing(miss, rec).collect()) == list(range(101, 112, 2))


def test_merge_keeps_every_live_row_and_adds_recovered(spark):
    live = spark.createDataFrame([("c", "D", 1, "a"), ("c", "D", 1, "a"), ("c", "E", 5, "x")],
                                 "channel string, feed_date string, seq bigint, message string")
    rec = spark.createDataFrame([("c", "D", 2, "b", "recovered")],
                                "channel string, feed_date string, seq bigint, message string, source string")
    got = sorted(tuple(r) for r in R.merge_feed(live, rec).collect())
    # a duplicate live packet is delivered twice (at-least-once), every date is kept
    assert got == [("c", "D", 1, "a", "live"), ("c", "D", 1, "a", "live"), ("c", "D", 2, "b", "recovered"),
                   ("c", "E", 5, "x", "live")]


def test_the_archive_answers_long_requests_by_their_ranges(spark):
    """No lost number of a request is written out to be looked up; an empty answer is one, too."""
    from feedspark.plans.feed import archive_replies

    parts = "array<struct<lo:bigint,hi:bigint>>"
    far = 10 ** 15
    sent = spark.createDataFrame([("c", "d", 0, far, [(0, 8), (20, far)], 1), ("c", "d", far + 2, far + 3, [(far + 2, far + 3)], 1),
                                  ("c", "e", 6, 9, [(6, 9)], 1)], f"channel string, feed_date string, lo bigint, hi bigint, parts {parts}, attempts int")
    archive = spark.createDataFrame([("c", "d", n, m) for n, m in [(3, "a"), (3, "b"), (9, "no"), (15, "no"), (far - 1, "z"), (far + 1, "no"), (4, None)]]
                                    + [("c", "e", 7, "x"), ("c", None, 3, "no"), (None, "d", 3, "no")],
                                    "channel string, feed_date string, seq bigint, message string")
    got = {(r.feed_date, r.lo): r.body for r in archive_replies(sent, archive).collect()}
    assert got == {("d", 0): f"Missed Packets:\n3^a\n3^b\n{far - 1}^z", ("d", far + 2): "Missed Packets:\n", ("e", 6): "Server busy"}
