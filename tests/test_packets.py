import base64
import datetime as dt

from pyspark.sql import functions as F

from feedspark.operators import packets as P


def _wire(plain: bytes, key: bytes) -> str:
    x = bytes(b ^ key[i % len(key)] for i, b in enumerate(plain)) if key else plain
    return base64.b64encode(x).decode()


CUR, SEC = b"curcipher0", b"cursecret0"
OLD, OSEC = b"Zq9-older7", b"prevsecret"
TS = dt.datetime(2024, 1, 1)


def _keyed(spark, wires):
    rows = [(TS, "c", w, CUR.decode(), SEC.decode(), OLD.decode(), OSEC.decode()) for w in wires]
    return spark.createDataFrame(
        rows, "arrival_ts timestamp_ntz, channel string, wire string, cipher string, secret string, "
              "prev_cipher string, prev_secret string")


def test_size_label_boundary_and_delivery(spark):
    df = spark.createDataFrame([("a" * 4999,), ("a" * 5000,)], "w string")
    assert [r.big for r in df.select(P.oversize(F.col("w")).alias("big")).collect()] == [False, True]
    keyed = _keyed(spark, [_wire(SEC + b"^20240101^5^" + b"m" * 9000, CUR)]).withColumn("epoch", F.lit(0))
    got = P.parse_fields(P.authenticate(keyed))
    assert got.first().message == "m" * 9000
    c = P.gate_counts(got).first()
    assert (c.status, c.packets, c.oversize) == ("passed_current", 1, 1)


def test_secret_check_and_fallback(spark):
    wires = [
        _wire(SEC, CUR),                      # 10 bytes: too short
        _wire(SEC + b"^", CUR),               # 11 bytes: passes, empty body
        _wire(SEC + b"^20240101^5^m", CUR),   # current key
        _wire(OSEC + b"^20240101^6^m", OLD),  # previous key
        _wire(b"wrongpass0^20240101^7^m", CUR),
    ]
    got = P.authenticate(_keyed(spark, wires)).select("status", F.col("body").cast("string").alias("b")).collect()
    assert [r.status for r in got] == ["bad_secret", "passed_current", "passed_current", "passed_previous", "bad_secret"]
    assert got[1].b == "" and got[2].b == "20240101^5^m" and got[3].b == "20240101^6^m"


def test_nine_byte_secret_never_matches(spark):
    rows = [(TS, "c", _wire(b"short9sec^^20240101^1^m", b"k"), "k", "short9sec", None, None)]
    df = spark.createDataFrame(rows, "arrival_ts timestamp_ntz, channel string, wire string, cipher string, "
                                     "secret string, prev_cipher string, prev_secret string")
    assert P.authenticate(df).first().status == "bad_secret"


def test_parse_rules(spark):
    bodies = ["d^1^m", "d^1", "d^1^", "d^^m", "d^1^m^x", " 12x^3^m"]
    wires = [_wire(SEC + b"^" + b.encode(), CUR) for b in bodies]
    dec = P.authenticate(_keyed(spark, wires)).select("arrival_ts", "channel", "wire", "status", "body", F.lit(0).alias("epoch"))
    got = P.parse_fields(dec).collect()
    assert [r.status for r in got] == ["passed_current", "incomplete", "incomplete", "incomplete",
                                       "passed_current", "passed_current"]
    assert (got[0].feed_date, got[0].seq, got[0].message, got[0].extra_fields) == ("d", 1, "m", 0)
    assert (got[4].message, got[4].extra_fields) == ("m", 1)
    assert got[5].feed_date == " 12x" and got[5].seq == 3


def test_legacy_checksum(spark):
    tail = "^120511^7^0^price"
    s = sum(tail.encode())
    rows = [(f"{s}{tail}",), (f"{s + 1}{tail}",), ("junk",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("binary").alias("body"))
    got = P.legacy_check(df).collect()
    assert [r.valid for r in got] == [True, False, False]
    assert got[0].checksum == s and got[0].legacy_seq == 7 and got[0].legacy_message == "price"


def test_kafka_records_decode_like_files(spark):
    from feedspark.sources.kafka import wire_from_kafka

    ts = dt.datetime(2024, 1, 1, 5)
    recs = [(b"c", _wire(SEC + b"^20240101^5^m", CUR).encode(), "t", 0, 1, ts),
            (None, _wire(SEC + b"^20240101^6^n", CUR).encode(), "t", 0, 2, ts)]
    df = spark.createDataFrame(recs, "key binary, value binary, topic string, partition int, offset bigint, "
                                     "timestamp timestamp")
    w = wire_from_kafka(df)
    assert [r.channel for r in w.collect()] == ["c", "t"]
    keyed = w.select("*", F.lit(CUR.decode()).alias("cipher"), F.lit(SEC.decode()).alias("secret"),
                     F.lit(None).cast("string").alias("prev_cipher"), F.lit(None).cast("string").alias("prev_secret"), F.lit(0).alias("epoch"))
    got = P.parse_fields(P.authenticate(keyed)).collect()
    assert [(r.seq, r.message) for r in got] == [(5, "m"), (6, "n")]
