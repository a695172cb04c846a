import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from feedspark.operators.framing import join_frames, pending_frames, split_frames
from feedspark.session import ROCKSDB, conf_override, scratch_path
from feedspark.streaming import frames as FR


def test_texts_of_a_channel_wait_under_many_keys(spark, monkeypatch):
    """Messages within and over segments, one of many segments, one channel null; frames in any order, a hole filled late, replays."""
    monkeypatch.setattr(FR, "_SEGMENT", 8)
    monkeypatch.setattr(FR, "_BLOCK", 16)
    rng = random.Random(4)
    texts = [(rng.choice(["a", "a", None]), i, "é" * rng.choice([0, 1, 9, 40, 400 if i == 30 else 20])) for i in range(80)]
    frames = split_frames(spark.createDataFrame(texts, "channel string, n long, text string"), "channel", "n", "text", size=16)
    frames = frames.select(*FR.FRAMES.fieldNames()).cache()
    last = frames.groupBy("channel").agg(F.max("pos").alias("last"))
    open_tail = frames.alias("f").join(last.alias("l"), F.expr("f.channel <=> l.channel and pos = last"), "left_anti").cache()
    rows = sorted(map(tuple, open_tail.collect()), key=lambda r: (r[0] or "", r[1]))
    hole = rows.pop(next(i for i, r in enumerate(rows) if r[0] == "a" and r[1] == 70))
    rng.shuffle(rows)
    landed, sink, ck = (scratch_path(spark, n) for n in ("frames", "messages", "ck"))

    def run(*files):
        for some in files:
            spark.createDataFrame(some, FR.FRAMES).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(FR.FRAMES).option("maxFilesPerTrigger", 1).parquet(landed)
        FR.start_reassembly(stream, sink, ck, partitions=3).awaitTermination()
        return sorted(map(str, spark.read.schema(FR.MESSAGES).parquet(sink).collect()))

    want = {(r.channel, r.msg_id): r for r in join_frames(open_tail.where("channel is not null")).collect()}
    k = len(rows) // 3
    run(rows[:k], rows[k:2 * k] + rows[:9], rows[2 * k:])
    with conf_override(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        ids = [r[0] for r in spark.read.format("state-metadata").load(ck).where("operatorProperties like '%\"held\"%'").select("operatorId").distinct().collect()]
        state = spark.read.format("statestore").option("path", ck).option("operatorId", ids[0]).option("stateVarName", "held").load()
        keys = state.groupBy("key.channel", "key.segment").agg(F.max(F.size("user_map_value.pos")).alias("n")).collect()
    assert len([r for r in keys if r.channel == "a"]) > 5 and max(r.n for r in keys) <= 8
    held = {r.pos for r in FR.held_frames(spark, ck).where("channel = 'a'").collect()}
    start = max(m.first_pos + m.n_frames for m in want.values() if m.first_pos + m.n_frames <= 70)
    assert held == {r[1] for r in rows if r[0] == "a" and r[1] >= start}
    got = run([hole, *rows[:20]])
    columns = FR.MESSAGES.fieldNames()
    assert [m for m in got if "channel='a'" in m] == sorted(str(r) for r in join_frames(open_tail.where("channel = 'a'")).select(*columns).collect())
    named = open_tail.where("channel is null").withColumn("channel", F.lit("null"))
    assert len([m for m in got if "channel=None" in m]) == join_frames(named).count() > 10
    tail = {(r.pos, bytes(r.mtext)) for r in pending_frames(open_tail.where("channel = 'a'")).collect()}
    assert {(r.pos, bytes(r.mtext)) for r in FR.held_frames(spark, ck).where("channel = 'a'").collect()} == tail


def test_known_frames_are_not_replaced_by_replays(spark, monkeypatch):
    """A frame of the open message that came without a hole before it stays as it was; one behind a hole gives way to a later one."""
    monkeypatch.setattr(FR, "_SEGMENT", 2)
    landed, sink, ck = (scratch_path(spark, n) for n in ("frames", "messages", "ck"))
    for rows in ([(0, "a", 0), (1, "b", 0), (3, "d", 0)], [(0, "x", 0), (1, "y", 0), (3, "z", 0)], [(2, "c", 0), (4, "e", 1), (5, "f", 0)]):
        frames = [("c", p, t.encode(), f) for p, t, f in rows]
        spark.createDataFrame(frames, FR.FRAMES).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(FR.FRAMES).parquet(landed)
        FR.start_reassembly(stream, sink, ck, partitions=2).awaitTermination()
    assert [tuple(r) for r in spark.read.schema(FR.MESSAGES).parquet(sink).collect()] == [("c", 0, 0, 5, "abcze", 5)]
    assert [(r.pos, bytes(r.mtext)) for r in FR.held_frames(spark, ck).collect()] == [(5, b"f")]


def test_state_calls_grow_with_entries_and_not_with_their_square(monkeypatch):
    """Frames go to the state forty times; each time costs a call per block, however many entries it has."""
    monkeypatch.setattr(FR, "_HOLD_BYTES", 1)
    monkeypatch.setattr(FR, "_BLOCK", 64)
    rng, calls, at, waiting = random.Random(6), [], [], {}

    def counted(fn):
        return lambda *a: (calls.append(a), fn(*a))[1]

    state = SimpleNamespace(getValue=counted(waiting.get), containsKey=counted(waiting.__contains__),
                            updateValue=counted(waiting.__setitem__), removeKey=counted(waiting.pop))
    value = SimpleNamespace(get=lambda: at[-1] if at else None, update=at.append, exists=lambda: bool(at))
    op = FR.Reassembly()
    op.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda *a: state))
    frames = [(p, b"t", int(p % 3 == 2)) for p in range(1, 640 * 3)]
    rng.shuffle(frames)

    def batch(rows):
        parts = [pd.DataFrame(rows[i:i + 48], columns=["pos", "mtext", "full_msg"]) for i in range(0, len(rows), 48)]
        return [m for df in op.handleInputRows(("c",), iter(parts), None) for m in df.itertuples(index=False, name=None)]

    assert batch(frames) == [] and len(calls) <= len(waiting) + 30 and len(waiting) > 500
    entries = len(waiting)
    calls.clear()
    assert [m[3] for m in batch([(0, b"t", 0)])] == [3] * 640 and not waiting
    assert len(calls) < 2.5 * entries
