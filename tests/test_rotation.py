import base64
import datetime as dt
from types import SimpleNamespace

from feedspark import schemas
from feedspark.session import scratch_path
from feedspark.streaming import rotation as RG
from feedspark.streaming.gate import land_wire, read_wire_stream

T0, HOUR = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
CIPHERS = ["alphaalpha", "bravobravo", "charliecha"]


def _enc(text, key):
    return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text))).decode()


def _fold(epoch):
    return ("c", epoch, T0 + epoch * HOUR, True, epoch, CIPHERS[epoch], f"secret{epoch:04d}", 60, None, None)


def _packet(epoch, n, at=None):
    at = T0 + epoch * HOUR + dt.timedelta(minutes=n) if at is None else at
    return (at, "c", _enc(f"secret{epoch:04d}^20240101^{n}^m".encode(), CIPHERS[epoch].encode()))


def test_a_new_key_wakes_the_packets_that_wait(spark):
    fold, wire, out, ck = (scratch_path(spark, n) for n in ("fold", "wire", "gate", "ck"))
    spark.createDataFrame([_fold(0)], schemas.KEY_FOLD).write.parquet(fold)

    def go(rows=(), epoch=None):
        if rows:
            land_wire(spark.createDataFrame(list(rows), schemas.WIRE), wire, 1)
        if epoch is not None:
            spark.createDataFrame([_fold(epoch)], schemas.KEY_FOLD).write.mode("append").parquet(fold)
        RG.start_gate(read_wire_stream(spark, wire), fold, out, ck, lanes=3, partitions=2).awaitTermination()
        return (sorted(r.seq for r in RG.read_packets(spark, out).collect()), RG.waiting(spark, ck).count(),
                sorted(r.reason for r in RG.read_rejected(spark, out).collect()))

    bad = (T0 + dt.timedelta(minutes=30), "c", _enc(b"nosecret00^20240101^9^m", CIPHERS[0].encode()))
    early, timeless, empty = _packet(0, 1, T0 - HOUR), (None, "c", "x"), (T0, "c", None)
    assert go([_packet(0, 1), _packet(1, 2), bad, early, timeless, empty, _packet(0, 1)]) == ([1, 1], 3, ["no_key", "no_key"])
    assert go([_packet(2, 3)]) == ([1, 1], 4, ["no_key", "no_key"])
    # the key of epoch 1 alone, without a packet: it passes one, ends the wait of two, and one goes on waiting
    assert go(epoch=1) == ([1, 1, 2], 1, ["bad_secret", "bad_secret", "no_key", "no_key"])
    assert go(epoch=1)[0] == [1, 1, 2]                                       # a repeated epoch is no news
    assert go([_packet(1, 4)], epoch=2) == ([1, 1, 2, 3, 4], 0, ["bad_secret", "bad_secret", "no_key", "no_key"])


def test_an_epoch_that_comes_before_its_predecessor():
    book = RG.KeyBook([(0, 0, "alphaalpha", "secret0000", None, None), (2, 200, "charliecha", "secret0002", None, None)])
    dec = [base64.b64decode(_packet(e, 1)[2]) for e in (0, 1, 2)]
    import numpy as np

    epoch, status, _, final = book.judge(np.array([50, 150, 250]), dec)
    assert epoch.tolist() == [0, 0, 2] and status == ["passed_current", "bad_secret", "passed_current"]
    assert final.tolist() == [True, False, True]                             # epoch 1 may still come


class _Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _List(_Value):
    def get(self):
        return iter(self.v or [])

    def appendList(self, rows):
        self.v = (self.v or []) + rows


class _Map(dict):
    updateValue, removeKey = dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(self.items())


def test_the_timer_ends_a_wait():
    import pandas as pd

    timers, held = [], _Map()
    handle = SimpleNamespace(getListState=lambda *a: _List(), getMapState=lambda *a: held, getValueState=lambda *a: _Value(),
                             registerTimer=timers.append)
    gate = RG.RotatingGate(hold_ms=1000)
    gate.init(handle)

    def rows(n):
        return iter([pd.DataFrame({"kind": [1] * n, "epoch": [-1] * n, "at": [5] * n, "wire": ["w"] * n, "decoded": [b"x"] * n,
                                   **{k: [None] * n for k in ("cipher", "secret", "prev_cipher", "prev_secret")}})])

    def at(ms):
        return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)

    assert sum(len(p) for p in gate.handleInputRows(("c", 0), rows(2), at(100))) == 0
    assert sum(len(p) for p in gate.handleInputRows(("c", 0), rows(1), at(600))) == 0
    assert timers == [1100] and len(held) == 3
    out = pd.concat(gate.handleExpiredTimer(("c", 0), at(1150), at(1100)))
    assert out["status"].tolist() == ["no_key"] * 2 and len(held) == 1 and timers == [1100, 1600]


def test_counters_of_a_running_gate(spark):
    from feedspark.streaming import counters as CT

    fold, wire, out, ck, counts = (scratch_path(spark, n) for n in ("fold", "wire", "gate", "ck", "counters"))
    spark.createDataFrame([_fold(0), _fold(1)], schemas.KEY_FOLD).write.parquet(fold)
    rows = [_packet(0, 1), _packet(0, 2), _packet(1, 3), (T0, "c", "x"), (T0, "d", "x")]
    land_wire(spark.createDataFrame(rows, schemas.WIRE), wire, 1)
    listener = CT.BatchCounters(spark, ["c"], counts)
    spark.streams.addListener(listener)
    try:
        RG.start_gate(read_wire_stream(spark, wire), fold, out, ck, lanes=3, partitions=2, watch=CT.watch(["c"])).awaitTermination()
        assert listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    assert {(r.channel, r.status): (r.packets, r.oversize) for r in CT.read_counters(spark, counts).collect()} == {
        ("c", "passed_current"): (3, 0), ("c", "bad_secret"): (1, 0)}
    assert RG.waiting(spark, ck).select("channel").collect()[0].channel == "d"


def test_packets_that_wait_together_share_entries_of_the_state():
    import pandas as pd

    held, calls = _Map(), []
    state = {"epochs": _List(), "count": _Value()}
    handle = SimpleNamespace(getListState=lambda n, *a: state[n], getMapState=lambda *a: held, getValueState=lambda n, *a: state[n])
    held.updateValue = lambda k, v: (calls.append(k), held.__setitem__(k, v))
    gate = RG.RotatingGate()
    gate.init(handle)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    names = ("cipher", "secret", "prev_cipher", "prev_secret")
    wires = [base64.b64decode(_packet(e, 1)[2]) for e in (0, 1)]
    n = 3000
    packets = pd.DataFrame({"kind": [1] * n, "epoch": [-1] * n, "at": [5, 25] * (n // 2), "wire": ["w"] * n, "decoded": wires * (n // 2),
                            **{k: [None] * n for k in names}})

    def epoch(e):
        return pd.DataFrame({"kind": [0], "epoch": [e], "at": [20 * e], "wire": [None], "decoded": [None], "cipher": [CIPHERS[e]],
                             "secret": [f"secret{e:04d}"], "prev_cipher": [None], "prev_secret": [None]})

    assert sum(map(len, gate.handleInputRows(("c", 0), iter([packets]), now))) == 0
    assert len(calls) <= n // RG._ENTRY_ROWS + 1 and sum(len(v[0]) for v in held.values()) == n
    out = pd.concat(gate.handleInputRows(("c", 0), iter([epoch(0)]), now))   # half of every entry leaves
    assert out["status"].tolist() == ["passed_current"] * (n // 2) and state["count"].get()[1] == n // 2
    out = pd.concat(gate.handleInputRows(("c", 0), iter([epoch(1)]), now))
    assert out["status"].tolist() == ["passed_current"] * (n // 2) and not held and state["count"].get()[1] == 0
