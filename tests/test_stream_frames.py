import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from feedspark.operators.framing import join_frames, split_frames
from feedspark.session import scratch_path
from feedspark.streaming import frames as FR


def _frames(spark):
    rng = random.Random(2)
    texts = [("a" if i % 4 else "b", i, "é" * rng.choice([0, 1, 5, 30, 31, 200])) for i in range(60)]
    return split_frames(spark.createDataFrame(texts, "channel string, n long, text string"), "channel", "n", "text", size=16)


def test_messages_come_whole_whatever_the_order_of_frames(spark):
    """Frames shuffled over files, some twice, the last one of a channel late, in two runs of one checkpoint."""
    frames = _frames(spark).cache()
    landed, sink, ck = (scratch_path(spark, n) for n in ("frames", "messages", "ck"))
    last = frames.groupBy("channel").agg(F.max("pos").alias("pos"))
    late = frames.join(last, ["channel", "pos"], "left_semi").select(*FR.FRAMES.fieldNames())
    early = frames.join(last, ["channel", "pos"], "left_anti").select(*FR.FRAMES.fieldNames())
    early.orderBy(F.rand(1)).repartition(5).write.mode("append").parquet(landed)
    early.where("pos % 3 = 0").coalesce(1).write.mode("append").parquet(landed)

    def run():
        stream = spark.readStream.schema(FR.FRAMES).option("maxFilesPerTrigger", 1).parquet(landed)
        FR.start_reassembly(stream, sink, ck, partitions=2).awaitTermination()
        return sorted(map(tuple, spark.read.schema(FR.MESSAGES).parquet(sink).collect()))

    whole = sorted((r.channel, r.msg_id, r.first_pos, r.n_frames, r.message, r.n_bytes) for r in join_frames(frames).collect())
    newest = {c: max(m[1] for m in whole if m[0] == c) for c in "ab"}
    got = run()
    assert got == [m for m in whole if m[1] < newest[m[0]]]
    held = {(r.channel, r.pos) for r in FR.held_frames(spark, ck).collect()}
    assert held == {(m[0], p) for m in whole if m[1] == newest[m[0]] for p in range(m[2], m[2] + m[3] - 1)}
    late.write.mode("append").parquet(landed)
    late.write.mode("append").parquet(landed)
    assert run() == whole and FR.held_frames(spark, ck).count() == 0


def test_frames_that_wait_share_entries_of_the_state(monkeypatch):
    """State calls go by blocks, memory by ``_HOLD_BYTES``: frames in any order, some twice, one hole that is filled late."""
    import pandas as pd

    monkeypatch.setattr(FR, "_HOLD_BYTES", 40_000)
    monkeypatch.setattr(FR, "_BLOCK", 128)
    rng, calls, at, waiting = random.Random(5), [], [], {}

    def counted(fn):
        return lambda *a: (calls.append(a), fn(*a))[1]

    state = SimpleNamespace(getValue=counted(waiting.get), containsKey=counted(waiting.__contains__),
                            updateValue=counted(waiting.__setitem__), removeKey=counted(waiting.pop))
    value = SimpleNamespace(get=lambda: at[-1] if at else None, update=at.append, exists=lambda: bool(at))
    op = FR.Reassembly()
    op.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda *a: state))
    n, hole = 3000, 700
    frames = [(p, bytes([p % 251]) * 50, int(rng.random() < 0.3 or p == n - 1)) for p in range(n)]
    frames[hole - 300:hole + 300] = [(p, t, 0) for p, t, _ in frames[hole - 300:hole + 300]]           # a message of many blocks
    first = [f for f in frames if f[0] != hole]
    rng.shuffle(first)

    def batch(rows):
        parts = [pd.DataFrame(rows[i:i + 400], columns=["pos", "mtext", "full_msg"]) for i in range(0, len(rows), 400)]
        return [m for df in op.handleInputRows(("c",), iter(parts), None) for m in df.itertuples(index=False, name=None)]

    got = batch(first[:1500]) + batch(first[1000:])
    assert len(calls) < n / 2 and at[-1][1] == hole
    held = {p for pos, _, _ in waiting.values() for p in pos}
    assert held == set(range(at[-1][0], n)) - {hole}
    got += batch([frames[hole], frames[3]])
    assert not waiting and at[-1][1] == n
    assert [m[1] for m in got] == list(range(sum(f[2] for f in frames))) and sum(m[3] for m in got) == n
    assert b"".join(t for _, t, _ in frames).decode("utf-8", errors="replace").count("a") == sum(m[4].count("a") for m in got)
    assert sum(m[5] for m in got) == 50 * n
