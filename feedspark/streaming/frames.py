"""Reassembly on a stream (M2, M3): frames wait in keyed state until their message is whole.

Three steps, of which the first alone has a channel as one key:

* the line of a channel takes positions and flags without texts, packed by
  task, and says which messages are whole and how far the open one is known;
* the texts wait by segment of positions, so that a channel is as many keys as
  it has segments, and leave as pieces of the messages that are whole;
* the pieces of all messages that begin in one segment are put together.

A message is whole in the micro-batch that brings the last of its frames, so all
its pieces come in that batch and the third step has no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedspark import constants as C
from feedspark.session import ROCKSDB, conf_override, state_partitions

FRAMES = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("mtext", T.BinaryType()),
    T.StructField("full_msg", T.IntegerType()),
])
MESSAGES = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("msg_id", T.LongType()),
    T.StructField("first_pos", T.LongType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("n_bytes", T.IntegerType()),
])
PACKED = "channel string, pos binary, full_msg binary"
PIECES = "channel string, home bigint, msg_id bigint, first_pos bigint, n_frames bigint, pos bigint, body binary"


_BLOCK = 1 << 13                           # positions of an entry's block in a line
_SEGMENT = 1 << 12                         # positions whose texts wait under one key
_HOLD_BYTES = 32 << 20                     # new frames kept in memory before they go to the state, messages before they are given out
_ROW_BYTES = 16                            # of a frame or message besides its text

_ENTRY = "pos array<bigint>, mtext array<binary>, full_msg array<int>"
_Entry = tuple[np.ndarray, np.ndarray, np.ndarray]


def _entry(pos, texts, flags) -> _Entry:
    mtext = np.empty(len(pos), object)
    mtext[:] = texts
    return np.asarray(pos, np.int64), mtext, np.asarray(flags, np.int32)


def _in_order(entries: list[_Entry]) -> _Entry:
    """The frames of ``entries`` by position; of those that came more than once the last."""
    if not entries:
        return _entry([], [], [])
    pos, texts, flags = (np.concatenate(c) for c in zip(*entries))
    at = np.argsort(pos, kind="stable")
    at = at[np.append(np.diff(pos[at]) != 0, True)[:len(at)]]
    return pos[at], texts[at], flags[at]


def _between(frames: _Entry, start: int, end: int | None = None) -> _Entry:
    i, j = np.searchsorted(frames[0], (start, start if end is None else end)).tolist()
    return tuple(c[i:None if end is None else j] for c in frames)


def _body(texts) -> bytes:
    return b"".join(t for t in texts if t)


class Reassembly(StatefulProcessor):
    """Emits every message of a channel once all frames up to its closing one are there, in the order of their positions.

    State of a channel: where its open message starts, up to where its frames
    are known without a hole, and the frames that wait.  These lie in map entries
    by block of positions; what a micro-batch adds to a block is an entry of its
    own, so that none is rewritten, and a state call moves many frames.  At most
    ``_HOLD_BYTES`` of new frames, the block that is read and the message that is
    put together are in memory; a message that comes whole in a small batch never
    enters the state.
    """

    entry_type = _ENTRY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "start bigint, reach bigint, msg_id bigint")
        self.waiting = handle.getMapState("waiting", "block bigint, run int", self.entry_type)

    def _chunks(self, pdf: pd.DataFrame) -> Iterator[_Entry]:
        yield pdf["pos"].to_numpy(), pdf["mtext"].to_numpy(object), pdf["full_msg"].to_numpy()

    def _stored_as(self, frames: _Entry) -> tuple:
        return tuple(c.tolist() for c in frames)

    def _read(self, value) -> _Entry:
        return _entry(*value)

    def _count(self, block: int) -> int:
        """Entries of a block in the state, found without a look at each."""
        have, none = 0, 1                  # so many are there; not so many
        while self.waiting.containsKey((block, none - 1)):
            have, none = none, 2 * none
        while none - have > 1:
            mid = (have + none) // 2
            have, none = (mid, none) if self.waiting.containsKey((block, mid - 1)) else (have, mid)
        return have

    def _stored(self, block: int, counts: dict[int, int]) -> list[_Entry]:
        """The entries of a block in the state."""
        entries = []
        while (value := self.waiting.getValue((block, len(entries)))) is not None:
            entries.append(self._read(value))
        counts[block] = len(entries)
        return entries

    def _add(self, frames: _Entry, counts: dict[int, int]) -> None:
        """Frames into the state, an entry per block; ``counts`` has the entries of the blocks that were looked at."""
        blocks = frames[0] // _BLOCK
        cuts = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            block = int(blocks[i])
            run = counts[block] if block in counts else self._count(block)
            self.waiting.updateValue((block, run), self._stored_as(tuple(c[i:j] for c in frames)))
            counts[block] = run + 1

    def _drop(self, block: int, counts: dict[int, int]) -> None:
        for run in range(counts[block] if block in counts else self._count(block)):
            self.waiting.removeKey((block, run))
        counts[block] = 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, reach, msg_id = begin = tuple(self.at.get() or (0, 0, 0))
        new, held, moves, counts = [], 0, False, {}
        for pos, texts, flags in (chunk for pdf in rows for chunk in self._chunks(pdf)):
            keep = pos >= reach
            new.append((pos[keep], texts[keep], flags[keep]))
            moves = moves or bool((pos == reach).any())      # a frame at ``reach`` never waits
            held += sum(len(t) for t in texts[keep] if t) + _ROW_BYTES * int(keep.sum())
            if held > _HOLD_BYTES:
                self._add(_in_order(new), counts)
                new, held = [], 0
        new = _in_order(new)
        if moves:                          # else the hole is still there
            gone, reach, parts, done, held = start // _BLOCK, start, [], [], 0       # entries of blocks before ``gone`` are dropped
            while True:
                block = reach // _BLOCK
                frames = _in_order([*self._stored(block, counts), _between(new, block * _BLOCK, (block + 1) * _BLOCK)])
                pos, texts, flags = _between(frames, reach)
                n, at = int((pos == np.arange(reach, reach + len(pos))).sum()), 0     # positions rise: these come first
                for end in (np.flatnonzero(flags[:n] == 1) + 1).tolist():
                    body = _body([*parts, *texts[at:end]])
                    n_frames = reach + end - start
                    done.append((key[0], msg_id, start, n_frames, body.decode("utf-8", errors="replace"), len(body)))
                    parts, at, start, msg_id = [], end, reach + end, msg_id + 1
                    held += len(body) + _ROW_BYTES
                parts.extend(texts[at:n])
                reach += n
                if held > _HOLD_BYTES:
                    yield pd.DataFrame(done, columns=MESSAGES.fieldNames())
                    done, held = [], 0
                while gone < start // _BLOCK:
                    self._drop(gone, counts)
                    gone += 1
                if reach // _BLOCK == block:
                    break
            if done:
                yield pd.DataFrame(done, columns=MESSAGES.fieldNames())
            stored = _in_order(self._stored(gone, counts))
            left = _between(stored, start)
            if len(left[0]) < len(stored[0]):
                self._drop(gone, counts)
                self._add(left, counts)
        self._add(_between(new, start), counts)
        if (start, reach, msg_id) != begin or not self.at.exists():
            self.at.update((start, reach, msg_id))

    def close(self) -> None:
        pass


class Line(Reassembly):
    """Reassembly of frames that come and wait packed and without texts.

    After the messages that are whole comes the open one, with ``n_bytes`` -1,
    if it is known further than before.
    """

    entry_type = "pos binary, full_msg binary"

    def _chunks(self, pdf):
        for value in zip(pdf["pos"], pdf["full_msg"]):
            yield self._read(value)

    def _stored_as(self, frames):
        return frames[0].astype(np.int64).tobytes(), frames[2].astype(np.int8).tobytes()

    def _read(self, value):
        pos = np.frombuffer(value[0], np.int64)
        return pos, np.empty(len(pos), object), np.frombuffer(value[1], np.int8)

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.at.get() or (0, 0, 0))
        yield from super().handleInputRows(key, rows, timerValues)
        start, reach, msg_id = self.at.get()
        if start < reach != before[1]:
            yield pd.DataFrame([(key[0], msg_id, start, reach - start, "", -1)], columns=MESSAGES.fieldNames())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``channel, pos, full_msg`` -> a row per channel and batch that has them all."""
    for batch in batches:
        codes = batch.column("channel").dictionary_encode(null_encoding="encode")
        of, pos, flags = (np.asarray(c) for c in (codes.indices, batch.column("pos"), batch.column("full_msg")))
        at = np.argsort(of, kind="stable")
        at = np.split(at, np.searchsorted(of[at], np.arange(1, len(codes.dictionary))))[:len(codes.dictionary)]
        yield pa.RecordBatch.from_arrays([
            codes.dictionary,
            pa.array([pos[a].astype(np.int64).tobytes() for a in at], pa.binary()),
            pa.array([(flags[a] == 1).astype(np.int8).tobytes() for a in at], pa.binary()),
        ], ["channel", "pos", "full_msg"])


class Texts(StatefulProcessor):
    """Holds the frames of a segment and gives out the pieces that it has of the messages that are whole.

    A message's row has its first position, ``n_frames`` and as ``full_msg``
    whether it is whole; a frame's row has 0 as ``n_frames``.  State of a
    segment: up to where the line knows its frames, and the frames that wait, an
    entry per micro-batch that brought some.  The first value stays, so that
    replays are told; the frames of the segment are in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("known", "reach bigint, runs int")
        self.held = handle.getMapState("held", "run int", _ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        channel, segment = key
        low, high = segment * _SEGMENT, (segment + 1) * _SEGMENT
        reach, runs = begin = tuple(self.at.get() or (low, 0))
        new, known, whole = [], reach, []
        for pdf in rows:
            frame = (pdf["n_frames"] == 0).to_numpy() & (pdf["pos"] >= known).to_numpy()
            new.append(_entry(*(pdf[c].to_numpy()[frame] for c in ("pos", "mtext", "full_msg"))))
            for first, flag, msg_id, n in pdf.loc[pdf["n_frames"] > 0, ["pos", "full_msg", "msg_id", "n_frames"]].itertuples(index=False, name=None):
                reach = max(reach, min(first + n, high))
                if flag == 1:
                    whole.append((first, msg_id, n))
        new = _in_order(new)
        if whole:
            whole.sort()
            start, end = max(whole[0][0], low), min(whole[-1][0] + whole[-1][2], high)
            frames = _in_order([*(_entry(*self.held.getValue((run,))) for run in range(runs)), new])
            pos, texts, _ = _between(frames, start, end)
            if len(pos) != end - start:
                raise RuntimeError(f"{channel}: {end - start - len(pos)} frames from {start} to {end} are not there")
            pieces = []
            for first, msg_id, n in whole:
                a, b = max(first, low), min(first + n, high)
                pieces.append((channel, first // _SEGMENT, msg_id, first, n, a, _body(texts[a - start:b - start])))
            yield pd.DataFrame(pieces, columns=["channel", "home", "msg_id", "first_pos", "n_frames", "pos", "body"])
            for run in range(runs):
                self.held.removeKey((run,))
            new, runs = _between(frames, end), 0
        if len(new[0]):
            self.held.updateValue((runs,), tuple(c.tolist() for c in new))
            runs += 1
        if (reach, runs) != begin:
            self.at.update((reach, runs))

    def close(self) -> None:
        pass


def _put_together(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of the messages that begin in one segment -> the messages."""
    p = pieces.sort_values(["first_pos", "pos"], ignore_index=True)
    cuts = [*np.flatnonzero(np.diff(p["first_pos"], prepend=-1)).tolist(), len(p)]
    bodies = p["body"].tolist()
    joined = [bodies[i] if j - i == 1 else b"".join(bodies[i:j]) for i, j in zip(cuts, cuts[1:])]
    m = p.loc[cuts[:-1], ["channel", "msg_id", "first_pos", "n_frames"]]
    return m.assign(message=[b.decode("utf-8", errors="replace") for b in joined], n_bytes=[len(b) for b in joined])


def messages(frames: DataFrame) -> DataFrame:
    """Streaming frames -> whole messages, the columns of ``join_frames``.

    Positions of a channel start at 0.  Frames may come in any order and more
    than once; one that lies before the open message is a replay and is
    ignored.  The order of a channel is one line, so its positions and flags, 9
    bytes a frame, meet under one key; its texts are spread by ``_SEGMENT``
    positions, which with the longest message bound what a task holds of them.
    """
    frames = frames.where("pos >= 0").select(*FRAMES.fieldNames())
    line = frames.select("channel", "pos", "full_msg").mapInArrow(_packed, PACKED).groupBy("channel")
    told = line.transformWithStateInPandas(Line(), MESSAGES, "Append", "None").select(
        "channel",
        F.explode(F.sequence(F.expr(f"first_pos div {_SEGMENT}"), F.expr(f"(first_pos + n_frames - 1) div {_SEGMENT}"))).alias("segment"),
        F.col("first_pos").alias("pos"), F.lit(None).cast("binary").alias("mtext"),
        (F.col("n_bytes") >= 0).cast("int").alias("full_msg"), "msg_id", "n_frames")
    none = F.lit(0).cast("bigint")
    rows = frames.select("channel", F.expr(f"pos div {_SEGMENT}").alias("segment"), "pos", "mtext", "full_msg",
                         none.alias("msg_id"), none.alias("n_frames"))
    pieces = rows.unionByName(told).groupBy("channel", "segment").transformWithStateInPandas(Texts(), PIECES, "Append", "None")
    return pieces.groupBy("channel", "home").applyInPandas(_put_together, MESSAGES)


def start_reassembly(frames: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True, period: str = C.SCAN_PERIOD,
                     partitions: int | None = None):
    """The running query: whole messages are appended to a path table."""
    spark = frames.sparkSession
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    with conf_override(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                       spark__sql__shuffle__partitions=state_partitions(spark, partitions)):
        return (messages(frames).writeStream.format("parquet").option("path", sink_path)
                .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trig).start())


def held_frames(spark: SparkSession, checkpoint: str) -> DataFrame:
    """M3: the frames that wait in the state of a reassembly, read from its checkpoint: ``channel, pos, mtext, full_msg``."""
    with conf_override(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        operators = spark.read.format("state-metadata").load(checkpoint)
        texts = operators.where(F.col("operatorProperties").contains('"held"')).select("operatorId").distinct().collect()
        state = (spark.read.format("statestore").option("path", checkpoint).option("operatorId", texts[0][0])
                 .option("stateVarName", "held").load())
        f = state.select("key.channel", "user_map_key.run", F.explode(F.arrays_zip(
            *[f"user_map_value.{c}" for c in ("pos", "mtext", "full_msg")])).alias("f")).select("channel", "run", "f.*")
        # a frame that came again waits twice; the last one counts
        last = f.groupBy("channel", "pos").agg(F.max_by(F.struct("mtext", "full_msg"), "run").alias("f"))
        return last.select("channel", "pos", "f.mtext", "f.full_msg")
