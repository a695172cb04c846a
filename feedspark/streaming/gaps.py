"""Stateful loss detection on a stream (L5, L6) with late healing.

State is kept per (channel, feed_date, bucket) where bucket = seq div width,
so a hot date spreads over many state keys and tasks.  Each key holds the
lowest and highest number seen and its open gap ranges (ranges, not numbers).
The ranges are a map with one entry per block of ``BLOCK`` numbers that a range starts in,
with a bitmap of the blocks in use beside it: a late number
reads and writes the entries of its own block and of the last block in use
before it, however many ranges are open.
A new number above the maximum opens the run between; a number inside an
open range closes it and re-opens what is left on either side.  The query
emits ``opened`` / ``closed`` range rows, ``bounds`` rows, and ``evicted`` rows
for state that the retention period ends; the current missing set is their fold (``fold_gap_events``), with the gaps that straddle
buckets rebuilt from the bounds exactly as the batch operator does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedspark import constants as C
from feedspark.operators.loss import _apart, expand_ranges, range_size
from feedspark.operators.scan import scan
from feedspark.session import ROCKSDB

BLOCK = 256                                # numbers per map entry: it holds at most half as many ranges

EVENTS = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("feed_date", T.StringType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()),
])

def absorb(mn, mx, los: np.ndarray, his: np.ndarray, nums: np.ndarray):
    """Fold new numbers into (min, max, open ranges).  Pure numpy; returns the new state and events.

    Returns (mn, mx, los, his, opened_lo, opened_hi, closed_lo, closed_hi).
    """
    nums = np.unique(nums.astype(np.int64))
    empty = np.zeros(0, np.int64)
    if nums.size == 0:
        return mn, mx, los, his, empty, empty, empty, empty
    if mn is None:
        cand_lo, cand_hi, real = np.array([nums[0]]), np.array([nums[-1]]), np.array([False])
        new_mn, new_mx = int(nums[0]), int(nums[-1])
    else:
        parts_lo, parts_hi, parts_real = [los], [his], [np.ones(len(los), bool)]
        new_mn, new_mx = min(mn, int(nums[0])), max(mx, int(nums[-1]))
        if new_mn < mn:  # virtual range below the old minimum
            parts_lo.append(np.array([new_mn])), parts_hi.append(np.array([mn - 1])), parts_real.append(np.array([False]))
        if new_mx > mx:  # virtual range above the old maximum
            parts_lo.append(np.array([mx + 1])), parts_hi.append(np.array([new_mx])), parts_real.append(np.array([False]))
        cand_lo, cand_hi, real = np.concatenate(parts_lo), np.concatenate(parts_hi), np.concatenate(parts_real)
        order = np.argsort(cand_lo, kind="stable")
        cand_lo, cand_hi, real = cand_lo[order], cand_hi[order], real[order]
    if cand_lo.size == 0:  # nothing open and nothing new outside [mn, mx]: all numbers known
        return new_mn, new_mx, los, his, empty, empty, empty, empty
    # which candidate range (if any) holds each new number
    r = np.searchsorted(cand_lo, nums, side="right") - 1
    inside = (r >= 0) & (nums <= cand_hi[np.maximum(r, 0)])
    nums, r = nums[inside], r[inside]
    hit = np.zeros(len(cand_lo), bool)
    hit[r] = True
    # pieces left of the hit ranges once the numbers are taken out
    starts = np.sort(np.concatenate([cand_lo[hit], nums + 1]))
    ends = np.sort(np.concatenate([nums - 1, cand_hi[hit]]))
    keep = starts <= ends
    op_lo, op_hi = starts[keep], ends[keep]
    cl_lo, cl_hi = cand_lo[hit & real], cand_hi[hit & real]
    rest = ~hit & real
    new_los = np.concatenate([cand_lo[rest], op_lo])
    new_his = np.concatenate([cand_hi[rest], op_hi])
    o = np.argsort(new_los, kind="stable")
    return new_mn, new_mx, new_los[o], new_his[o], op_lo, op_hi, cl_lo, cl_hi


class RangeMap:
    """The open ranges of one state key, read and written by blocks; ``used`` is the bitmap of blocks that a range starts in."""

    def __init__(self, state, first: int, used: bytes):
        self.state, self.first = state, first
        self.used = int.from_bytes(used, "little")
        self.had: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def load(self, block: int) -> None:
        if block not in self.had:
            v = self.state.getValue((block,)) if self.used >> block & 1 else None
            self.had[block] = tuple(np.asarray(x, np.int64) for x in (v or ([], [])))

    def near(self, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ranges that may hold one of the numbers: those of its block and of the last block in use before it."""
        for block in np.unique((nums - self.first) // BLOCK).tolist():
            self.load(block)
            before = (self.used & ((1 << block) - 1)).bit_length() - 1
            if before >= 0:
                self.load(before)
        return self.loaded()

    def loaded(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.had[b] for b in sorted(self.had)]
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))

    def store(self, los: np.ndarray, his: np.ndarray) -> bytes:
        """Put ``los, his`` in the place of the ranges that are loaded, writing blocks that change; the new bitmap."""
        at = (los - self.first) // BLOCK
        for block in sorted({*self.had, *np.unique(at).tolist()}):
            mine = at == block
            new = (los[mine], his[mine])
            if block not in self.had:      # starts came into a block that no number lies in: what it has stays
                self.load(block)
                both = [np.concatenate(p) for p in zip(self.had[block], new)]
                order = np.argsort(both[0], kind="stable")
                new = tuple(p[order] for p in both)
            if not all(np.array_equal(o, n) for o, n in zip(self.had[block], new)):
                if len(new[0]):
                    self.state.updateValue((block,), tuple(p.tolist() for p in new))
                    self.used |= 1 << block
                else:
                    self.state.removeKey((block,))
                    self.used &= ~(1 << block)
        return self.used.to_bytes((self.used.bit_length() + 7) // 8, "little")


class GapTracker(StatefulProcessor):
    """Keeps bounds and open ranges of a (channel, feed_date, bucket) and emits what changes."""

    def __init__(self, width: int, retention_ms: int | None):
        self.width, self.retention_ms = width, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "mn bigint, mx bigint, used binary, latest bigint")
        self.open = handle.getMapState("open", "block bigint", "los array<bigint>, his array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mn, mx, used, latest = self.at.get() or (None, None, b"", None)
        old, was = (mn, mx, bytes(used)), latest
        used, out = bytes(used), []
        for pdf in rows:
            nums = np.unique(pdf["seq"].to_numpy(np.int64))
            ranges = RangeMap(self.open, int(key[2]) * self.width, used)
            los, his = ranges.near(nums)
            mn, mx, los, his, olo, ohi, clo, chi = absorb(mn, mx, los, his, nums)
            used = ranges.store(los, his)
            out += [("opened", olo, ohi), ("closed", clo, chi)]
            if self.retention_ms is not None:
                newest = int(pd.to_datetime(pdf["ev"]).max().value // 1_000_000)
                latest = newest if latest is None else max(latest, newest)
        if (mn, mx) != old[:2]:
            out.append(("bounds", np.array([mn]), np.array([mx])))
        if (mn, mx, used) != old or latest != was:
            self.at.update((int(mn), int(mx), used, latest))
        if latest != was:
            if was is not None:
                self.handle.deleteTimer(was + self.retention_ms)
            self.handle.registerTimer(latest + self.retention_ms)
        yield self._events(key, out)

    def _events(self, key, parts) -> pd.DataFrame:
        n = [len(lo) for _, lo, _ in parts]
        kinds = np.repeat(np.array([k for k, _, _ in parts], object), n)
        both = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2)]
        return pd.DataFrame({"channel": pd.Series([key[0]] * sum(n), dtype=object), "feed_date": pd.Series([key[1]] * sum(n), dtype=object),
                             "bucket": np.full(sum(n), int(key[2])), "kind": pd.Series(kinds, dtype=object),
                             "lo": both[0], "hi": both[1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the date left tracking (no arrivals for the retention period): its ranges stay as logged, and the log says so
        if not self.at.exists():
            return
        mn, mx, _, _ = self.at.get()
        self.at.clear()
        self.open.clear()
        yield self._events(key, [("evicted", np.array([mn]), np.array([mx]))])

    def close(self) -> None:
        pass


def gap_events(packets: DataFrame, width: int = C.SEQ_BUCKET, retention_s: int | None = None) -> DataFrame:
    """Streaming packets -> opened / closed / bounds rows per (channel, date, bucket).

    With ``retention_s`` a date stops being tracked once no packet of it has
    arrived for that long in event time (watermark on ``arrival_ts``): its
    state is dropped and later packets of it no longer change its gaps -- the
    stream form of keeping only the live dates.  The feed itself keeps them.

    The state needs the RocksDB store, which this sets for the session.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = ["channel", "feed_date", "seq", F.floor(F.col("seq") / F.lit(width)).cast("bigint").alias("bucket")]
    if retention_s is None:
        x, mode = packets.select(*cols), "None"
    else:
        x = packets.select(*cols, F.col("arrival_ts").cast("timestamp").alias("ev"))
        x, mode = x.withWatermark("ev", f"{int(retention_s)} seconds"), "EventTime"
    tracker = GapTracker(width, None if retention_s is None else int(retention_s) * 1000)
    return x.groupBy("channel", "feed_date", "bucket").transformWithStateInPandas(tracker, EVENTS, "Append", mode)


def fold_gap_events(events: DataFrame) -> DataFrame:
    """Current gap ranges from the event log: open interior ranges plus the gaps between buckets."""
    keys = ["channel", "feed_date"]
    rng = events.where(F.col("kind").isin("opened", "closed")).groupBy(*keys, "lo", "hi").agg(
        F.sum(F.when(F.col("kind") == "opened", 1).otherwise(-1)).alias("_open")
    )
    interior = rng.where(F.col("_open") > 0).select(*keys, "lo", "hi")
    b = events.where(F.col("kind") == "bounds").groupBy(*keys, "bucket").agg(
        F.min("lo").alias("_mn"), F.max("hi").alias("_mx")
    )
    cross = (
        scan(b, keys, ["bucket"], follow=F.col("_mn")).withColumnRenamed("following", "_nmn")
        .where(_apart("_mx", "_nmn"))
        .select(*keys, (F.col("_mx") + 1).alias("lo"), (F.col("_nmn") - 1).alias("hi"))
    )
    return interior.unionByName(cross).withColumn("n", range_size())


def missing_from_events(events: DataFrame) -> DataFrame:
    return expand_ranges(fold_gap_events(events))
