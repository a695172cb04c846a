import base64
import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from feedspark.operators import keys as K

BOOT = b"boot-key-x"


def _enc(text: bytes, key: bytes) -> str:
    return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()


def test_rotation_changes_state_only_on_good_replies(spark):
    t0 = dt.datetime(2024, 1, 1)
    replies = [
        _enc(b"cipherAAAA^secretAAAA^7", BOOT),       # good (decoded with the bootstrap key)
        _enc(b"cipherBBBB^secretBBBB", b"cipherAAAA"),  # bad shape
        _enc(b"cipherBBBB^^9", b"cipherAAAA"),         # blank field
        _enc(b"cipherCCCC^secretCCCC^0", b"cipherAAAA"),  # good
    ]
    rows = [("c", i, t0 + dt.timedelta(hours=i), w) for i, w in enumerate(replies)]
    rows += [("d", 0, t0, _enc(b"x^y", BOOT)), ("d", 1, t0, _enc(b"dd^ss^2147483647", BOOT))]
    df = spark.createDataFrame(rows, "channel string, ord int, arrival_ts timestamp_ntz, wire string")
    f = {(r.channel, r.ord): r for r in K.fold_replies(df).collect()}
    assert [f[("c", i)].ok for i in range(4)] == [True, False, False, True]
    assert [f[("c", i)].refresh_s for i in range(4)] == [7, 2, 2, 30]
    assert f[("c", 2)].cipher == "cipherAAAA" and f[("c", 2)].prev_cipher is None
    assert (f[("c", 3)].cipher, f[("c", 3)].secret, f[("c", 3)].prev_cipher, f[("c", 3)].prev_secret) == (
        "cipherCCCC", "secretCCCC", "cipherAAAA", "secretAAAA")
    assert f[("d", 0)].ok is False and f[("d", 1)].ok is True and f[("d", 1)].refresh_s == 30
    ep = K.key_epochs(K.fold_replies(df)).collect()
    assert sorted((r.channel, r.epoch) for r in ep) == [("c", 0), ("c", 1), ("d", 0)]


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    epochs = []
    for ch in ("a", "b"):
        t = t0 + dt.timedelta(minutes=rnd.randint(0, 90))
        for e in range(12):
            epochs.append((ch, e, t, f"c{ch}{e}", f"s{ch}{e}", 30, None, None))
            t += dt.timedelta(minutes=rnd.randint(1, 400))
    pk = [(rnd.choice("ab"), t0 + dt.timedelta(seconds=rnd.randint(0, 60 * 3000))) for _ in range(400)]
    edf = spark.createDataFrame(epochs, "channel string, epoch int, effective_from timestamp_ntz, cipher string, "
                                        "secret string, refresh_s int, prev_cipher string, prev_secret string")
    pdf = spark.createDataFrame(pk, "channel string, arrival_ts timestamp_ntz").withColumn("id", F.monotonically_increasing_id())
    got = {r.id: r.epoch for r in K.asof_keys(pdf, edf).collect()}
    ep = pd.DataFrame(epochs, columns=["channel", "epoch", "effective_from", "c", "s", "r", "pc", "ps"])
    for r in pdf.collect():
        cand = ep[(ep.channel == r.channel) & (ep.effective_from <= r.arrival_ts)]
        want = None if cand.empty else int(cand.sort_values("effective_from").epoch.iloc[-1])
        assert got[r.id] == want


def test_asof_ties_and_early_packets(spark):
    t0 = dt.datetime(2024, 1, 1, 5)
    h = dt.timedelta(hours=1)
    epochs = [("a", 0, t0, "k0"), ("a", 1, t0 + h, "k1"), ("a", 2, t0 + h, "k2"), ("a", 3, t0 + 3 * h, "k3"), ("b", 0, t0 + 9 * h, "z")]
    e = spark.createDataFrame(epochs, "channel string, epoch int, effective_from timestamp_ntz, cipher string").withColumns(
        {c: F.lit(None).cast("string") for c in ("secret", "prev_cipher", "prev_secret")})
    pk = [("a", t0 - h), ("a", t0), ("a", t0 + h), ("a", t0 + 2.5 * h), ("a", t0 + 50 * h), ("b", t0), ("c", t0)]
    p = spark.createDataFrame(pk, "channel string, arrival_ts timestamp_ntz")
    got = {(r.channel, r.arrival_ts): r.cipher for r in K.asof_keys(p, e).collect()}
    assert [got[x] for x in pk] == [None, "k0", "k2", "k2", "k3", None, None]
    assert K.asof_keys(p.where("false"), e).count() == 0


def test_asof_rows_do_not_grow_with_the_span_of_times(spark):
    """A clock that says year 9999, one that says year 1, a packet without a time; columns named like the join's own."""
    e = spark.createDataFrame([("x", 0, dt.datetime(2024, 1, 1), "k"), ("x", 1, dt.datetime(9000, 1, 1), "far")],
                              "channel string, epoch int, effective_from timestamp_ntz, cipher string")
    e = e.withColumns({c: F.lit(None).cast("string") for c in ("secret", "prev_cipher", "prev_secret")})
    at = [dt.datetime(9999, 12, 31), dt.datetime(1, 1, 1), dt.datetime(2024, 6, 1), None]
    p = spark.createDataFrame([("x", t, i) for i, t in enumerate(at)], "channel string, arrival_ts timestamp_ntz, id int")
    p = p.withColumns({c: F.lit("own") for c in ("carried", "_kind", "_key")})
    out = K.asof_keys(p, e)
    assert out.columns == [*p.columns, *K.KEY_COLS]
    assert {r.id: r.cipher for r in out.collect()} == {0: "far", 1: None, 2: "k", 3: None}
