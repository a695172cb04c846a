"""The gate as one keyed operator (K2+K4): packets that need a newer key wait in state and are woken by it.

Two streams meet: wire packets, and the rows of the rotation fold
(``streaming/keys.py``).  State is kept per (channel, lane): the epochs known
so far and the packets that wait.  A lane is a hash of the
packet, so a hot channel spreads over ``lanes`` tasks; each lane gets every
epoch of its channel, control-plane rows of which there is one per refresh.

A packet is judged when it comes, under the epoch in force at its arrival
time among those known.  It waits if it fails there and the next epoch is not
known yet; a new epoch judges the waiting packets of its channel again, in the
micro-batch that brings the epoch.  A batch writes state only for packets that
begin or end their wait.  Packets that begin it together share map entries of
bounded size, so a state call moves many of them; a few are kept one each, so
that one that leaves rewrites no other.  Nothing is dropped: a packet leaves with the status
of the batch gate, or is still to be read in the state (``waiting``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedspark import constants as C
from feedspark import schemas
from feedspark.functions.codec import auth_kernel, b64_decode_prefix, b64_prefix
from feedspark.operators import packets as P
from feedspark.operators.packets import BAD_SECRET, NO_KEY, PASSED_CURRENT, PASSED_PREVIOUS    # by name: the operator is sent to tasks
from feedspark.session import ROCKSDB, conf_override, state_partitions
from feedspark.streaming import counters

LANES = 16                                 # tasks that a channel's packets spread over
_FEW = 16                                  # so many packets that begin their wait at once are kept one each
_ENTRY_ROWS, _ENTRY_BYTES = 512, 1 << 18   # of more, an entry holds so many packets, or so many bytes of them and one packet
_ENTRIES = 64                              # entries that a walk over the state gets at a time
_NO_TIME = -(1 << 63)                      # arrival of a packet without a time

JUDGED = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("at", T.LongType()),
    T.StructField("wire", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("body", T.BinaryType()),
])
# What ``start_gate`` writes: the rows of ``parse_fields``; the wire only of rows that did not pass.
OUT = T.StructType([*schemas.PACKETS.fields, T.StructField("wire", T.StringType()), T.StructField("epoch", T.IntegerType()),
                    T.StructField("status", T.StringType())])
_KEYS = ["cipher", "secret", "prev_cipher", "prev_secret"]
_EPOCH_STATE = "epoch int, at bigint, cipher string, secret string, prev_cipher string, prev_secret string"
_HELD_STATE = "at array<bigint>, wire array<string>, decoded array<binary>, tried array<int>, since bigint"


class KeyBook:
    """The epochs that a lane knows, in the order of their start; of equal starts the last one holds."""

    def __init__(self, epochs: list[tuple]):
        rows = sorted({int(e[0]): e for e in epochs}.values(), key=lambda e: (e[1], e[0]))
        self.epoch = np.array([e[0] for e in rows], np.int64)
        self.start = np.array([e[1] for e in rows], np.int64)
        known = set(self.epoch.tolist())
        self.followed = np.array([e + 1 in known for e in self.epoch.tolist()], bool)
        self.begun = 0 in known            # the first epoch is known, so what lies before it has no key for good
        self.keys = [pa.array([None if e[i] is None else e[i].encode() for e in rows], pa.binary()) for i in range(2, 6)]

    def judge(self, at: np.ndarray, decoded: list) -> tuple[np.ndarray, list, list, np.ndarray]:
        """(epoch or -1, status, body, final) of packets by arrival time; what is not final may pass under a key to come."""
        n = len(at)
        i = np.searchsorted(self.start, at, side="right") - 1
        i[at == _NO_TIME] = -1
        has = i >= 0
        epoch, final = np.full(n, -1), np.full(n, self.begun) | (at == _NO_TIME)
        status, body = [NO_KEY] * n, [None] * n
        if has.any():
            epoch[has], final[has] = self.epoch[i[has]], self.followed[i[has]]
            rows = np.nonzero(has)[0]
            take = pa.array(i[rows])
            auth = auth_kernel(pa.array([decoded[r] for r in rows], pa.binary()), *[pc.take(k, take) for k in self.keys])
            for r, code, text in zip(rows, auth.field("code").to_pylist(), auth.field("body").to_pylist()):
                status[r] = (BAD_SECRET, PASSED_CURRENT, PASSED_PREVIOUS)[code]
                body[r] = text
                final[r] |= code > 0
        return epoch, status, body, final


def _entries(wait: np.ndarray, wire: list) -> Iterator[np.ndarray]:
    """The packets ``wait`` that share an entry of the state."""
    if len(wait) <= _FEW:
        yield from (wait[i:i + 1] for i in range(len(wait)))
        return
    begin, size = 0, 0
    for i, packet in enumerate(wait):
        if i - begin == _ENTRY_ROWS or size > _ENTRY_BYTES:
            yield wait[begin:i]
            begin, size = i, 0
        size += 2 * len(wire[packet] or "")
    yield wait[begin:]


def _opt(b):
    return None if b is None else bytes(b)


class RotatingGate(StatefulProcessor):
    """Judges packets under the epochs of their channel and holds those that a later epoch may still pass."""

    def __init__(self, hold_ms: int | None = None):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epochs = handle.getListState("epochs", _EPOCH_STATE)
        self.held = handle.getMapState("held", "no bigint", _HELD_STATE)
        self.count = handle.getValueState("count", "next bigint, held bigint")

    def _rows(self, channel, at, wire, judged, pick) -> pd.DataFrame:
        epoch, status, body, _ = judged

        def text(values):
            return pd.Series(list(values), dtype=object)

        return pd.DataFrame({"channel": text([channel] * len(pick)), "at": at[pick], "wire": text(wire[i] for i in pick),
                             "epoch": epoch[pick].astype(np.int32), "status": text(status[i] for i in pick),
                             "body": text(body[i] for i in pick)}, columns=JUDGED.fieldNames())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(e) for e in self.epochs.get()]
        book, fresh = KeyBook(known), []
        nxt, n_held = self.count.get() or (0, 0)
        begin, now = (nxt, n_held), max(timerValues.getCurrentProcessingTimeInMs(), 0)
        for pdf in rows:
            is_key = (pdf["kind"] == 0).to_numpy()
            for e in pdf[is_key][["epoch", "at", *_KEYS]].itertuples(index=False):
                fresh.append((int(e[0]), int(e[1]), *[None if pd.isna(v) else v for v in e[2:]]))
            part = pdf[~is_key]
            if not len(part):
                continue
            at = part["at"].to_numpy(np.int64)
            wire = [None if pd.isna(w) else w for w in part["wire"]]
            decoded = [_opt(d) for d in part["decoded"]]
            judged = book.judge(at, decoded)
            wait = np.nonzero(~judged[3])[0]
            for own in _entries(wait, wire):
                self.held.updateValue((nxt,), self._entry(own, at, wire, decoded, judged[0], now))
                nxt += 1
            n_held += len(wait)
            yield self._rows(key[0], at, wire, judged, np.nonzero(judged[3])[0])
        fresh = [e for e in fresh if e[0] not in {k[0] for k in known}]      # a replayed epoch is no news
        if fresh:
            self.epochs.appendList(fresh)
            for out, gone in self._wake(key[0], KeyBook(known + fresh), n_held):
                n_held -= gone
                yield out
        if (nxt, n_held) != begin:
            self.count.update((nxt, n_held))
        if self.hold_ms is not None and n_held and not begin[1]:
            self.handle.registerTimer(now + self.hold_ms)

    @staticmethod
    def _entry(own, at, wire, decoded, epoch, since) -> tuple:
        return ([int(at[i]) for i in own], [wire[i] for i in own], [decoded[i] for i in own], [int(epoch[i]) for i in own], since)

    def _wake(self, channel, book: KeyBook, n_held: int, since: int | None = None):
        """Judge the waiting packets again; with ``since`` those that wait since then or longer leave whatever the outcome."""
        empty = []
        for no, v in self.held.iterator() if n_held else ():
            at, wire, decoded = np.array(v[0], np.int64), list(v[1]), [_opt(d) for d in v[2]]
            judged = book.judge(at, decoded)
            if since is not None and v[4] <= since:
                judged[3][:] = True
            stay = np.nonzero(~judged[3])[0]
            if not len(stay):
                empty.append(int(no[0]))
            elif len(stay) < len(at) or any((judged[0] < 0) != (np.array(v[3]) < 0)):
                self.held.updateValue((int(no[0]),), self._entry(stay, at, wire, decoded, judged[0], v[4]))
            if len(stay) < len(at):
                yield self._rows(channel, at, wire, judged, np.nonzero(judged[3])[0]), len(at) - len(stay)
        for no in empty:                   # after the walk; an entry that shrinks keeps its place in it
            self.held.removeKey((no,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nxt, n_held = self.count.get() or (0, 0)
        since = expiredTimerInfo.getExpiryTimeInMs() - self.hold_ms
        for out, gone in self._wake(key[0], KeyBook([tuple(e) for e in self.epochs.get()]), n_held, since):
            n_held -= gone
            yield out
        self.count.update((nxt, n_held))
        if n_held:
            first = min(int(v[4]) for v in self.held.values())
            self.handle.registerTimer(first + self.hold_ms)

    def close(self) -> None:
        pass


def _micros(ts: Column) -> Column:
    return F.coalesce(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")), F.lit(_NO_TIME))


def _time(at: Column) -> Column:
    return F.when(at != _NO_TIME, F.timestamp_add("MICROSECOND", at, F.lit("1970-01-01").cast("timestamp_ntz")))


def judge_stream(wire: DataFrame, fold: DataFrame, lanes: int = LANES, hold_s: int | None = None,
                 watch: list[Column] | None = None) -> DataFrame:
    """Streams of packets and of fold rows -> judged packets, parsed (``OUT``).

    Repeated packets are judged each; a repeated epoch is ignored.  A packet
    without a time, or from before the first epoch, has no key and is rejected
    as ``no_key``; a null wire never passes.  With ``hold_s`` a packet that has
    waited that long (processing time, also on a quiet feed) is rejected under
    the last epoch known; without it packets wait as long as no newer epoch is
    known.  ``watch`` are aggregates over the judged rows that every batch
    observes (``streaming/counters.py``).
    """
    text = wire.select("channel", _micros(F.col("arrival_ts")).alias("at"), "wire", b64_prefix(F.col("wire")).alias("_b64"))
    packets = text.select("channel", F.pmod(F.xxhash64("wire", "at"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), "at",
                          F.lit(-1).alias("epoch"), *[F.lit(None).cast("string").alias(k) for k in _KEYS],
                          "wire", b64_decode_prefix(F.col("_b64")).alias("decoded"))
    epochs = fold.where("ok").select(
        "channel", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"),
        _micros(F.col("arrival_ts")).alias("at"), "epoch", *_KEYS,
        F.lit(None).cast("string").alias("wire"), F.lit(None).cast("binary").alias("decoded"))
    gate = RotatingGate(None if hold_s is None else int(hold_s * 1000))
    judged = packets.unionByName(epochs).groupBy("channel", "lane").transformWithStateInPandas(
        gate, JUDGED, "Append", "None" if hold_s is None else "ProcessingTime")
    parsed = P.parse_fields(judged.select(_time(F.col("at")).alias("arrival_ts"), "channel", "wire",
                                          F.when(F.col("epoch") >= 0, F.col("epoch")).alias("epoch"), "status", "body"))
    if watch:
        parsed = parsed.observe(counters.NAME, *watch)
    passed = F.col("status").isin(P.PASSED_CURRENT, P.PASSED_PREVIOUS)
    return parsed.withColumn("wire", F.when(~passed, F.col("wire"))).select(*OUT.fieldNames())


def start_gate(wire: DataFrame, fold_path: str, out: str, checkpoint: str, available_now: bool = True, period: str = C.SCAN_PERIOD,
               lanes: int = LANES, hold_s: int | None = None, partitions: int | None = None,
               watch: list[Column] | None = None):
    """The running gate: judged rows are appended to a path table by status, exactly once.

    ``lanes`` and ``partitions`` are fixed at the first start.  A run that ends
    when all files are read (``available_now``) has no use for ``hold_s``.
    """
    spark = wire.sparkSession
    if available_now and hold_s is not None:
        raise ValueError("hold_s needs a query that keeps running")
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    fold = spark.readStream.schema(schemas.KEY_FOLD).parquet(fold_path)
    with conf_override(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                       spark__sql__execution__arrow__transformWithStateInPySpark__maxStateRecordsPerBatch=_ENTRIES,
                       spark__sql__shuffle__partitions=state_partitions(spark, partitions)):
        return (judge_stream(wire, fold, lanes, hold_s, watch).writeStream.format("parquet").partitionBy("status").option("path", out)
                .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trig).start())


def judged_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows that the gate has let go, passed or rejected."""
    return spark.read.schema(OUT).parquet(out)


def read_packets(spark: SparkSession, out: str) -> DataFrame:
    """The packets that the gate has passed so far."""
    return P.complete_packets(judged_rows(spark, out))


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    """Rows rejected for good, with their reason."""
    return P.quarantine_rows(judged_rows(spark, out))


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Packets that wait in the state of a gate, with the reason that holds if no key comes."""
    with conf_override(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
        v = state.select("key.channel", F.explode(F.arrays_zip("user_map_value.at", "user_map_value.wire", "user_map_value.tried")).alias("p"))
        v = v.select("channel", "p.*")
        return v.select(_time(F.col("at")).alias("arrival_ts"), "channel", "wire",
                        F.when(F.col("tried") < 0, P.NO_KEY).otherwise(P.BAD_SECRET).alias("reason"))
