"""Registered queries that write: table sinks, preflight, audit, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import schemas
from feedspark.operators import loss as L
from feedspark.operators import packets as P
from feedspark.operators.numbering import number_rows
from feedspark.plans.catalog import _but_last, _frames, _plan, query
from feedspark.session import materialize, scratch_path
from feedspark.sinks import audit as A
from feedspark.sinks import commits as CM
from feedspark.sinks import deliver as D
from feedspark.sinks import tables as S
from feedspark.sources.delivered import read_on
from feedspark.streaming import counters as CT
from feedspark.streaming import frames as FR
from feedspark.streaming import gate as G
from feedspark.streaming import rotation as RG
from feedspark.streaming.gaps import EVENTS, missing_from_events


@query("sink_rows")
def q_sink_rows(spark, sf_dir):
    """S3+S5+S11: the merged feed with serial ids, appended to a path table and read back."""
    feed = _plan(spark, sf_dir).feed
    path = scratch_path(spark, "feed_table")
    rows = S.with_ids(feed)
    S.append_path(rows, path)
    # the written schema, not partition-folder inference (feed_date stays a string)
    return spark.read.schema(rows.schema).parquet(path).select("id", "channel", "feed_date", "seq", "message", "source")


@query("sink_rows_twice")
def q_sink_rows_twice(spark, sf_dir):
    """S5+S11: the feed delivered in two parts, the second one twice (a replay): ids go on and stay unique."""
    feed = _plan(spark, sf_dir).feed
    path = scratch_path(spark, "delivered")
    D.deliver_batch(feed.where("seq % 2 = 0"), path, 0)
    D.deliver_batch(feed.where("seq % 2 = 1"), path, 1)
    D.deliver_batch(feed.where("seq % 2 = 1"), path, 1)
    return D.read_delivered(spark, path)


@query("stream_deliver")
def q_stream_deliver(spark, sf_dir):
    """S11 on a stream: the feed landed as files, delivered per micro-batch."""
    landed, path = scratch_path(spark, "feed_landed"), scratch_path(spark, "delivered")
    _plan(spark, sf_dir).feed.select(*schemas.FEED.fieldNames()).repartition(4).write.parquet(landed)
    stream = spark.readStream.schema(schemas.FEED).option("maxFilesPerTrigger", 2).parquet(landed)
    D.start_delivery(stream, path, scratch_path(spark, "ck_deliver")).awaitTermination()
    rows = D.read_delivered(spark, path)
    # which rows share a batch is up to the file listing; that ids are dense and unique is not
    ids = number_rows(rows, [], ["id"], out="at").select("channel", "feed_date", "seq", "message", "source",
                                                         (F.col("id") == F.col("at") + 1).alias("dense"))
    return ids


@query("consumer_resume")
def q_consumer_resume(spark, sf_dir):
    """S7+S9: a consumer that is stopped twice while the feed is delivered in three parts: every row once, by position."""
    feed = _plan(spark, sf_dir).feed
    path, got, ck = (scratch_path(spark, n) for n in ("delivered", "consumed", "ck_consumer"))

    def take(batch, batch_id):
        batch.withColumn("got_by", F.lit(batch_id)).write.mode("overwrite").parquet(f"{got}/run={batch_id}")

    for part in range(3):
        D.deliver_batch(feed.where(F.col("seq") % 3 == part), path, part)
        D.start_consumer(read_on(spark, path), take, ck).awaitTermination()
    rows = spark.read.schema("id long, channel string, feed_date string, seq long, message string, source string, got_by long").parquet(got)
    return rows.drop("run")


@query("sink_preflight")
def q_sink_preflight(spark, sf_dir):
    """Create the catalog table, then add columns it lacks, then append the feed and read it back."""
    name = f"feed_sink_{uuid.uuid4().hex[:10]}"
    loc = scratch_path(spark, name)
    first = S.preflight(spark, name, "message", location=loc)
    more = {"channel": "STRING", "feed_date": "STRING", "seq": "BIGINT", "source": "STRING"}
    second = S.preflight(spark, name, "message", extra_columns=more)
    if not (first and second):
        raise RuntimeError(f"sink preflight failed: {first.reason or second.reason}")
    S.append_table(S.with_ids(_plan(spark, sf_dir).feed), name)
    return _taken_out(spark, name).select("id", "channel", "feed_date", "seq", "message", "source")


def _taken_out(spark, name):
    """The table's rows by its files; the catalog entry goes, the files stay."""
    schema = spark.table(name).schema
    where = [r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect() if r["col_name"] == "Location"][0]
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schema).parquet(where)


def _faulty(feed):
    """The feed with ids, a null message at every 23rd number and text for a number at every 29th."""
    return S.with_ids(feed).select(
        "id", F.when(F.col("seq") % 23 != 0, F.col("message")).alias("message"), "feed_date",
        F.when(F.col("seq") % 29 == 0, F.concat(F.lit("no "), F.col("seq").cast("string"))).otherwise(F.col("seq").cast("string")).alias("seq"))


@query("sink_reject")
def q_sink_reject(spark, sf_dir):
    """The feed with a null message at every 23rd number and text for a number at every 29th: refused rows are kept aside."""
    name = f"feed_sink_{uuid.uuid4().hex[:10]}"
    ok = S.preflight(spark, name, "message", scratch_path(spark, name), {"feed_date": "STRING", "seq": "BIGINT"})
    if not ok:
        raise RuntimeError(f"sink preflight failed: {ok.reason}")
    aside = scratch_path(spark, "refused")
    rows = _faulty(_plan(spark, sf_dir).feed)
    S.append_checked(rows, name, aside)
    written = _taken_out(spark, name).select("id", F.col("seq").cast("string").alias("seq"), F.lit("").alias("reason"))
    return written.unionByName(spark.read.parquet(aside).select("id", "seq", "reason"))


@query("sink_reject_twice")
def q_sink_reject_twice(spark, sf_dir):
    """S3+S6: the rows of ``sink_reject`` in two batches, the first one failing before its commit, then tried twice."""
    root = scratch_path(spark, "once")
    schema = T.StructType.fromDDL("id BIGINT, message STRING, feed_date STRING, seq BIGINT")
    CM.create(spark, root)
    rows = materialize(_faulty(_plan(spark, sf_dir).feed), "faulty", spark)
    part = [rows.where(F.col("id") % 2 == k) for k in (0, 1)]

    def stop():
        raise ConnectionError("between the rows and their record")

    try:
        CM.append_once(part[0], root, 0, schema, {"id", "message"}, stop)
    except ConnectionError:
        pass
    for batch_id in (0, 0, 1, 0):
        CM.append_once(part[batch_id], root, batch_id, schema, {"id", "message"})
    written = CM.read_written(spark, root, schema).select("id", F.col("seq").cast("string").alias("seq"), F.lit("").alias("reason"))
    return written.unionByName(CM.read_refused(spark, root, schema).select(
        F.col("id").cast("bigint").alias("id"), "seq", F.col("_reason").alias("reason")))


@query("audit_lines")
def q_audit_lines(spark, sf_dir):
    """Audit rows for gate failures and per-date loss, in the log line format."""
    p = _plan(spark, sf_dir)
    return A.audit_rows(p.parsed, L.loss_summary(p.packets), p.packets).select("ts", "level", "text", "line")


def _start_fold(spark, replies, fold, checkpoint):
    from feedspark.streaming import keys as SK

    return SK.start_fold(SK.read_replies_stream(spark, replies), fold, checkpoint)


def _rotating_gate(spark, sf_dir, rounds: int = 4):
    """Packets and control replies landed in turn, packets first: each round's keys come after its packets.

    The gate runs after every landing of packets, which then wait for their
    keys, and goes on when the last keys are there.  Returns the gate's folder
    and its checkpoint.
    """
    p = _plan(spark, sf_dir)
    wire_in, replies_in, fold, out = (scratch_path(spark, n) for n in ("wire_landed", "replies_landed", "stream_fold", "gate"))
    ck = {n: scratch_path(spark, f"ck_{n}") for n in ("fold", "gate")}
    spark.createDataFrame([], schemas.KEY_FOLD).write.parquet(fold)
    part = F.least(F.floor((F.dayofmonth("arrival_ts") - 1) * rounds / 30), F.lit(rounds - 1))
    wire, replies = materialize(p.wire, "wire"), materialize(p.control_replies, "replies")

    def go_on():
        RG.start_gate(G.read_wire_stream(spark, wire_in), fold, out, ck["gate"]).awaitTermination()

    for r in range(rounds):
        G.land_wire(wire.where(part == r), wire_in, 2)
        go_on()
        replies.where(part == r).coalesce(1).write.mode("append").parquet(replies_in)
        _start_fold(spark, replies_in, fold, ck["fold"]).awaitTermination()
    go_on()
    return out, ck["gate"]


@query("stream_gate")
def q_stream_gate(spark, sf_dir):
    """S1+S9: all packet files as a stream under keys that are all known at the start."""
    p = _plan(spark, sf_dir)
    landed, fold, out = G.land_wire(p.wire, scratch_path(spark, "wire_landed")), scratch_path(spark, "fold"), scratch_path(spark, "gate")
    p.key_fold.write.parquet(fold)
    G.start_gate(G.read_wire_stream(spark, landed, 3), fold, out, scratch_path(spark, "ck_gate")).awaitTermination()
    return G.read_packets(spark, out)


@query("stream_rotation")
def q_stream_rotation(spark, sf_dir):
    """K2+K4 on streams: keys rotate while the gate runs and wake the packets that wait for them."""
    return RG.read_packets(spark, _rotating_gate(spark, sf_dir)[0])


@query("stream_quarantine")
def q_stream_quarantine(spark, sf_dir):
    """S6 on a stream: rows that the gate rejected, and those that no key fits until the end."""
    out, ck = _rotating_gate(spark, sf_dir)
    q = RG.read_rejected(spark, out).unionByName(RG.waiting(spark, ck))
    return q.select("arrival_ts", "channel", "reason", F.length("wire").cast("int").alias("wire_len"))


@query("stream_counters")
def q_stream_counters(spark, sf_dir):
    """L8 on a stream: counts that the gate observed, batch by batch, and the packets that still wait."""
    p = _plan(spark, sf_dir)
    wire, fold, out, ck, counts = (scratch_path(spark, n) for n in ("wire_landed", "fold", "gate", "ck_gate", "counters"))
    G.land_wire(p.wire, wire)
    p.key_fold.write.parquet(fold)
    channels = [r.channel for r in p.key_epochs.select("channel").distinct().collect()]
    spark.createDataFrame([], CT.COUNTS).write.parquet(f"{counts}/batch=-1")
    listener = CT.BatchCounters(spark, channels, counts)
    spark.streams.addListener(listener)
    try:
        RG.start_gate(G.read_wire_stream(spark, wire, 3), fold, out, ck, watch=CT.watch(channels)).awaitTermination()
        if not listener.ended.wait(120):
            raise RuntimeError("the gate's last progress did not come")
    finally:
        spark.streams.removeListener(listener)
    w = RG.waiting(spark, ck).groupBy("channel", F.col("reason").alias("status")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(P.oversize(F.col("wire"))).alias("oversize"))
    return CT.read_counters(spark, counts).unionByName(w).groupBy("channel", "status").agg(
        F.sum("packets").alias("packets"), F.sum("oversize").alias("oversize"))


def _stream_packets(spark, sf_dir):
    """Complete packets landed as files."""
    sink = scratch_path(spark, "stream_packets")
    _plan(spark, sf_dir).packets.repartition(4).write.parquet(sink)
    return spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", 2).parquet(sink)


@query("stream_gaps")
def q_stream_gaps(spark, sf_dir):
    """L5+L6: stateful gap tracking over the packet stream (numbers arrive out of order)."""
    events_path = scratch_path(spark, "gap_events")
    G.start_gaps(_stream_packets(spark, sf_dir), events_path, scratch_path(spark, "ck_gaps")).awaitTermination()
    return missing_from_events(spark.read.schema(EVENTS).parquet(events_path))


RETENTION_S = 5 * 86400


@query("stream_evicted")
def q_stream_evicted(spark, sf_dir):
    """L2 on a stream: dates that left tracking, five days (event time) after their last packet."""
    landed = scratch_path(spark, "by_time")
    packets = _plan(spark, sf_dir).packets
    for part in range(4):                  # in order of time, so that the watermark moves on
        packets.where(F.floor((F.dayofmonth("arrival_ts") - 1) / 8) == part).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", 1).parquet(landed)
    events_path = scratch_path(spark, "gap_events")
    G.start_gaps(stream, events_path, scratch_path(spark, "ck_gaps"), retention_s=RETENTION_S).awaitTermination()
    return spark.read.schema(EVENTS).parquet(events_path).where("kind = 'evicted'").select("channel", "feed_date").distinct()


@query("stream_key_epochs")
def q_stream_key_epochs(spark, sf_dir):
    """K2 on a stream: control replies landed in five successive files, folded with per-channel state."""
    from feedspark.operators.keys import key_epochs
    from feedspark.streaming import keys as SK

    p = _plan(spark, sf_dir)
    landed = SK.land_replies(p.control_replies, scratch_path(spark, "replies_landed"))
    out = scratch_path(spark, "stream_fold")
    _start_fold(spark, landed, out, scratch_path(spark, "ck_keys")).awaitTermination()
    return key_epochs(spark.read.schema(schemas.KEY_FOLD).parquet(out))


@query("stream_recovery")
def q_stream_recovery(spark, sf_dir):
    """The periodic recovery query over the gap-event log of the packet stream."""
    from feedspark.streaming import recovery as SR

    p = _plan(spark, sf_dir)
    events_path = scratch_path(spark, "gap_events")
    G.start_gaps(_stream_packets(spark, sf_dir), events_path, scratch_path(spark, "ck_gaps")).awaitTermination()
    out = scratch_path(spark, "recovered")
    SR.start_recovery(spark, events_path, p.archive, out, scratch_path(spark, "ck_rec")).awaitTermination()
    return SR.read_recovered(spark, out).select("channel", "feed_date", "seq", "message", "source")


@query("stream_recovery_rounds")
def q_stream_recovery_rounds(spark, sf_dir):
    """B6+B8: three ticks of the clock on a feed that has fallen quiet: what each brought, at which attempt of its request."""
    from feedspark.plans.feed import archive_replies
    from feedspark.streaming import retries as RT

    p = _plan(spark, sf_dir)
    events_path = scratch_path(spark, "gap_events")
    G.start_gaps(_stream_packets(spark, sf_dir), events_path, scratch_path(spark, "ck_gaps")).awaitTermination()
    out, checkpoint = scratch_path(spark, "retries"), scratch_path(spark, "ck_retries")
    for _ in range(3):                     # the gap events come with the first tick, nothing with the others
        RT.start_retries(spark, events_path, lambda sent, tick: archive_replies(sent, p.archive_at(tick)), out, checkpoint).awaitTermination()
    return RT.read_answered(spark, out).select(
        "channel", "feed_date", "seq", "message", "attempts", (F.col("batch_id") + 1).cast("int").alias("round"))


@query("feed_frames")
def q_feed_frames(spark, sf_dir):
    """S11 frames mode: the merged feed as a frame stream per channel, in (date, number) order."""
    from feedspark.sinks.deliver import feed_frames

    f = feed_frames(_plan(spark, sf_dir).feed)
    return f.select("channel", "pos", F.hex("mtext").alias("mtext_hex"), "full_msg")


def _reassembled(spark, sf_dir):
    """(sink, checkpoint) of a reassembly over frames whose files come in any order, each channel's last frame not at all."""
    landed, sink, ck = (scratch_path(spark, n) for n in ("frames_landed", "messages", "ck_frames"))
    # texts and positions are written by the split, so the last positions come from narrow rows and the frames are written once
    _but_last(_frames(spark, sf_dir)).select(*FR.FRAMES.fieldNames()).repartition(6).write.parquet(landed)
    stream = spark.readStream.schema(FR.FRAMES).option("maxFilesPerTrigger", 2).parquet(landed)
    FR.start_reassembly(stream, sink, ck).awaitTermination()
    return sink, ck


@query("stream_frames")
def q_stream_frames(spark, sf_dir):
    """M2 on a stream: messages put together over micro-batches."""
    sink, _ = _reassembled(spark, sf_dir)
    m = spark.read.schema(FR.MESSAGES).parquet(sink)
    return m.select("channel", "msg_id", "first_pos", "n_frames", F.md5(F.encode("message", "UTF-8")).alias("md5"), "n_bytes")


@query("stream_frames_held")
def q_stream_frames_held(spark, sf_dir):
    """M3 on a stream: the frames that the state holds back."""
    _, ck = _reassembled(spark, sf_dir)
    return FR.held_frames(spark, ck).select("channel", "pos", F.hex("mtext").alias("mtext_hex"))
