"""Key rotation on a stream (K2): the rotation fold with its state kept per channel.

Control replies arrive as landed files (or a topic).  The state of a channel
is its current and previous (cipher, secret), the epoch counter, the next
reply number due, and the replies that arrived ahead of a gap.  Each
micro-batch applies the contiguous run of replies from the next number due
with the same step as the batch fold; replies after a missing number wait in
state until it arrives or the wait is over, and replayed ones are ignored -- so the stream gives
the batch epochs whatever order the files are picked up in.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from feedspark import constants as C
from feedspark import schemas
from feedspark.functions.codec import b64_decode_lenient
from feedspark.operators.keys import fold_step, initial_state
from feedspark.sources.writer import BOOTSTRAP_KEY

WAIT_S = 7 * 86400                         # how long (by arrival times) replies wait for an earlier one

STATE = T.StructType([
    T.StructField("cipher", T.BinaryType()),
    T.StructField("secret", T.BinaryType()),
    T.StructField("prev_cipher", T.BinaryType()),
    T.StructField("prev_secret", T.BinaryType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("next_ord", T.IntegerType()),
    T.StructField("wait_ord", T.ArrayType(T.IntegerType())),
    T.StructField("wait_ts", T.ArrayType(T.LongType())),
    T.StructField("wait_dec", T.ArrayType(T.BinaryType())),
])


def _opt(b):
    return None if b is None else bytes(b)


def _skipped(channel: str, first: int, last: int, at) -> pd.DataFrame:
    """Log rows of replies that never came: not ok, no key."""
    n = last - first
    none = [None] * n
    return pd.DataFrame({"channel": [channel] * n, "ord": list(range(first, last)), "arrival_ts": [at] * n, "ok": [False] * n,
                         "epoch": [-1] * n, "cipher": none, "secret": none, "refresh_s": [C.REFRESH_AFTER_BAD_S] * n,
                         "prev_cipher": none, "prev_secret": none})


def _processor(bootstrap: bytes, first_ord: int, wait_s: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state):
        if state.exists:
            c, s, pc, ps, e, nxt, w_ord, w_ts, w_dec = state.get
            st = (bytes(c), _opt(s), _opt(pc), _opt(ps), int(e))
            waiting = pd.DataFrame({
                "channel": key[0], "ord": list(w_ord or []),
                "arrival_ts": pd.to_datetime(list(w_ts or []), unit="ns"), "decoded": list(w_dec or []),
            })
        else:
            st, nxt, waiting = initial_state(bootstrap), first_ord, None
        # one channel's replies: control-plane rows (one per rotation)
        parts = [p for p in pdfs] + ([waiting] if waiting is not None and len(waiting) else [])
        pdf = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["channel", "ord", "arrival_ts", "decoded"])
        pdf = pdf[pdf["ord"] >= nxt].drop_duplicates("ord").sort_values("ord", kind="stable")
        outs, later, newest = [], pdf, pd.to_datetime(pdf["arrival_ts"]).max() if len(pdf) else None
        while True:
            ords = later["ord"].to_numpy()
            run_len = 0
            while run_len < len(ords) and ords[run_len] == nxt + run_len:
                run_len += 1
            ready, later = later.iloc[:run_len], later.iloc[run_len:]
            st, out = fold_step(st, ready)
            outs.append(out)
            nxt += run_len
            # the reply that the others wait for is given up once they have waited long enough
            if not len(later) or newest - pd.to_datetime(later["arrival_ts"]).min() < pd.Timedelta(seconds=wait_s):
                break
            first = int(later["ord"].iloc[0])
            outs.append(_skipped(key[0], int(nxt), first, later["arrival_ts"].iloc[0]))
            nxt = first
        outs = [o for o in outs if len(o)]
        ts_ns = pd.to_datetime(later["arrival_ts"]).astype("int64").tolist() if len(later) else []
        state.update(st + (int(nxt), [int(o) for o in later["ord"]], [int(t) for t in ts_ns],
                           [bytes(d) if d is not None else None for d in later["decoded"]]))
        if outs:
            yield pd.concat(outs, ignore_index=True)

    return run


def fold_stream(replies: DataFrame, bootstrap_key: str = BOOTSTRAP_KEY, first_ord: int = 0, wait_s: int = WAIT_S) -> DataFrame:
    """Streaming replies (channel, ord, arrival_ts, wire) -> one fold row per reply (``KEY_FOLD``).

    Replies are numbered from ``first_ord`` per channel; one that arrives
    before an earlier number waits in state until that number arrives, or until
    replies ``wait_s`` younger have come: then the missing ones are logged as
    not ok and the fold goes on with the next reply.
    """
    pre = replies.select("channel", "ord", "arrival_ts", b64_decode_lenient("wire").alias("decoded"))
    return pre.groupBy("channel").applyInPandasWithState(
        _processor(bootstrap_key.encode(), first_ord, wait_s), schemas.KEY_FOLD, STATE, "append", GroupStateTimeout.NoTimeout
    )


def land_replies(replies: DataFrame, path: str, files: int = 5) -> str:
    """Land control replies in ``files`` successive appends (each a later file, so batches follow ``ord``)."""
    import time

    bounds = replies.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).first()
    lo, hi = int(bounds.lo), int(bounds.hi)
    step = max((hi - lo + 1 + files - 1) // files, 1)
    for start in range(lo, hi + 1, step):
        part = replies.where((F.col("ord") >= start) & (F.col("ord") < start + step))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # distinct modification times -> one micro-batch per append, in order
    return path


def read_replies_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.CONTROL_REPLIES).option("maxFilesPerTrigger", 1).parquet(path)


def start_fold(replies_stream: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True,
               period: str = "30 seconds", partitions: int | None = None, bootstrap_key: str = BOOTSTRAP_KEY, first_ord: int = 0,
               wait_s: int = WAIT_S):
    """K2 as a running query: appends one fold row per reply; state partitions fixed explicitly.

    ``wait_s`` (by arrival times) is how long a lost reply stops its channel: a
    few refresh periods of the feed.
    """
    from feedspark.session import conf_override, state_partitions

    spark = replies_stream.sparkSession
    trig = {"availableNow": True} if available_now else {"processingTime": period}
    with conf_override(spark, spark__sql__shuffle__partitions=state_partitions(spark, partitions)):
        return (
            fold_stream(replies_stream, bootstrap_key, first_ord, wait_s).writeStream.format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint).trigger(**trig).start()
        )
