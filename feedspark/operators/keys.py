"""Key rotation: the fold over control replies (K1-K3) and the as-of key join (K4)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark import constants as C
from feedspark import schemas
from feedspark.functions.codec import b64_decode_lenient
from feedspark.operators.scan import scan
from feedspark.sources.writer import BOOTSTRAP_KEY

_ATOI = re.compile(rb"^\s*([+-]?\d+)")


def _xor(value: bytes, key: bytes) -> bytes:
    if not key or not value:
        return value
    v = np.frombuffer(value, dtype=np.uint8)
    k = np.resize(np.frombuffer(key, dtype=np.uint8), len(v))
    return (v ^ k).tobytes()


def _refresh(raw: bytes) -> int:
    m = _ATOI.match(raw)
    v = int(m.group(1)) if m else 0
    if v in (0, C.INT_MAX, C.INT_MIN) or not (C.INT_MIN <= v <= C.INT_MAX):
        return C.REFRESH_FALLBACK_S
    return v


def _text(b: bytes | None) -> str | None:
    return None if b is None else b.decode("utf-8", errors="replace")


# Key state: (cipher, secret, prev_cipher, prev_secret, epoch); bytes, -1 before the first good reply.
KeyState = tuple


def initial_state(bootstrap: bytes) -> KeyState:
    return (bootstrap, None, None, None, -1)


def fold_step(state: KeyState, pdf: pd.DataFrame) -> tuple[KeyState, pd.DataFrame]:
    """Apply one channel's replies (any order; applied by ``ord``) to the key state.

    Each reply is decoded with the cipher of the last good reply; a good reply
    (exactly two '^', three non-empty fields) moves current -> previous; a bad
    one changes nothing and sets the refresh to 2 s.  Control-plane rows only.
    """
    cipher, secret, prev_cipher, prev_secret, epoch = state
    pdf = pdf.sort_values("ord", kind="stable")
    out = []
    for ch, o, ts, dec in zip(pdf["channel"], pdf["ord"], pdf["arrival_ts"], pdf["decoded"]):
        value = _xor(bytes(dec) if dec is not None else b"", cipher)
        parts = value.split(b"^") if value.count(b"^") == 2 else None
        ok = parts is not None and all(len(p) > 0 for p in parts)
        if ok:
            prev_cipher, prev_secret = (cipher if epoch >= 0 else None), secret
            cipher, secret = parts[0], parts[1]
            epoch += 1
            refresh = _refresh(parts[2])
        else:
            refresh = C.REFRESH_AFTER_BAD_S
        out.append(
            (ch, int(o), ts, ok, epoch, _text(cipher) if epoch >= 0 else None, _text(secret),
             refresh, _text(prev_cipher), _text(prev_secret))
        )
    res = pd.DataFrame(out, columns=schemas.KEY_FOLD.fieldNames())
    return (cipher, secret, prev_cipher, prev_secret, epoch), res


def _fold_channel(bootstrap: bytes):
    """Sequential fold of one channel's replies (ordered by ``ord``)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold_step(initial_state(bootstrap), pdf)[1]

    return fold


def fold_replies(replies: DataFrame, bootstrap_key: str = BOOTSTRAP_KEY) -> DataFrame:
    """K1+K2+K3: one row per control reply with the key state after it.

    Each reply is decoded with the cipher of the last *good* reply (the
    bootstrap key before the first); a good reply (exactly two '^', three
    non-empty fields) moves current -> previous; a bad one changes nothing and
    sets the refresh to 2 s (see ``fold_step``).  The chain is sequential
    within a channel and parallel across channels.  Its length is bounded by time / refresh period
    (control-plane rows, not data rows); base64 is decoded on the JVM first.
    """
    pre = replies.select("channel", "ord", "arrival_ts", b64_decode_lenient("wire").alias("decoded"))
    return pre.groupBy("channel").applyInPandas(_fold_channel(bootstrap_key.encode()), schema=schemas.KEY_FOLD)


def key_epochs(fold: DataFrame) -> DataFrame:
    """The key pairs in force: one row per good reply."""
    return fold.where("ok").select(
        "channel",
        "epoch",
        F.col("arrival_ts").alias("effective_from"),
        "cipher",
        "secret",
        "refresh_s",
        "prev_cipher",
        "prev_secret",
    )


def key_health(epochs: DataFrame) -> DataFrame:
    """Flags per epoch: secrets that are not exactly 10 bytes can never authenticate (Q18)."""
    return epochs.select(
        "*",
        (F.octet_length("secret") == C.SECRET_LEN).alias("secret_usable"),
        F.col("cipher").rlike(C.KEY_CHARS_PATTERN).alias("cipher_charset_ok"),
        (F.col("effective_from") + F.make_interval(secs=F.col("refresh_s"))).alias("next_refresh_due"),
    )


KEY_COLS = ["epoch", "cipher", "secret", "prev_cipher", "prev_secret"]


def asof_keys(packets: DataFrame, epochs: DataFrame, ts: str = "arrival_ts") -> DataFrame:
    """K4: attach the key pair in force at ``ts`` (as-of join, exact).

    Packets and epochs are put on one line per channel and the last epoch is
    carried along it (``scan``): one pass, in which no row is copied, whatever
    times packets and replies claim.  An epoch holds from its
    ``effective_from`` to the next one of its channel; of epochs that start at
    the same instant the last one holds.  Packets before any epoch, or
    without a time, keep null key columns.
    """
    kind = dict(packets.dtypes)[ts]
    key = F.struct(*KEY_COLS)
    p = packets.select(F.col("channel").alias("_ch"), F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(-1).alias("_n"),
                       F.struct(*packets.columns).alias("_row"))
    e = epochs.select(F.col("channel").alias("_ch"), F.col("effective_from").cast(kind).alias("_at"), F.lit(0).alias("_kind"),
                      F.col("epoch").alias("_n"), key.alias("_key"))
    line = scan(p.unionByName(e, allowMissingColumns=True), ["_ch"], ["_at", "_kind", "_n"], carry=F.col("_key"))
    return line.where("_kind = 1").select("_row.*", "carried.*")
