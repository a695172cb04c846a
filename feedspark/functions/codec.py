"""Byte codecs as Spark column expressions.

* ``b64_encode`` / ``b64_decode_lenient`` are pure JVM expressions (codegen).
* ``xor_bytes`` and ``byte_sum`` are Arrow UDFs: one numpy pass over the whole
  Arrow batch (flat data buffer + offsets), no Python work per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from feedspark import constants as C

# Work on at most this many payload bytes per numpy pass (bounds the index
# arrays built for a batch of large rows).
_CHUNK_BYTES = 1 << 20


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def b64_encode(c) -> Column:
    """Standard alphabet, '=' padded, one line (any CR/LF the engine inserts is removed)."""
    return F.regexp_replace(F.base64(_col(c).cast("binary")), r"[\r\n]", "")


B64_PREFIX = r"^[A-Za-z0-9+/]*"


def b64_prefix(c) -> Column:
    """The alphabet prefix a lenient decoder reads (stops at '=' or any other byte)."""
    return F.regexp_extract(_col(c), B64_PREFIX, 0)


def b64_decode_prefix(prefix) -> Column:
    """Decode an alphabet-only prefix: a single dangling character is ignored, two or three give one or two bytes.

    All arithmetic is unconditional, so a prefix held in its own column is read
    a few times but computed once.
    """
    s = _col(prefix)
    n = F.length(s)
    keep = n - (n % 4 == 1).cast("int")
    return F.unbase64(F.rpad(s.substr(F.lit(1), keep), F.ceil(keep / 4).cast("int") * 4, F.lit("=")))


def b64_decode_lenient(c) -> Column:
    """Lenient base64 decode that never fails.

    Reads the longest prefix of alphabet characters (it stops at '=' or at any
    other byte); a single dangling character is ignored; two or three dangling
    characters give one or two bytes.  For hot paths put ``b64_prefix`` in its
    own column first (the regex then runs once per row).
    """
    return b64_decode_prefix(b64_prefix(c))


# ---------------------------------------------------------------------------
# Arrow kernels (pure functions on pyarrow arrays; unit-tested directly)
# ---------------------------------------------------------------------------

def _binary_parts(arr: pa.Array):
    """(offsets int64[n+1], data uint8) of a binary/string array, slice-aware."""
    if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_binary())
        off_dtype = np.int64
    else:
        arr = arr.cast(pa.binary())
        off_dtype = np.int32
    bufs = arr.buffers()
    n = len(arr)
    offsets = np.frombuffer(bufs[1], dtype=off_dtype, count=arr.offset + n + 1)[arr.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def _row_chunks(offsets: np.ndarray):
    """Yield (start_row, end_row) so each chunk holds at most _CHUNK_BYTES bytes."""
    n = len(offsets) - 1
    start = 0
    while start < n:
        limit = offsets[start] + _CHUNK_BYTES
        end = int(np.searchsorted(offsets, limit, side="right")) - 1
        end = max(end, start + 1)
        end = min(end, n)
        yield start, end
        start = end


def xor_kernel(values: pa.Array, keys: pa.Array) -> pa.Array:
    """Byte-wise XOR of each value with its key repeated; an empty key is the identity.

    One pass of flat gathers over chunks of rows, so the index arrays stay
    within ``_CHUNK_BYTES`` of payload however large the batch is.  A batch's
    bytes fit 32-bit offsets, as Spark's batches do.
    """
    n = len(values)
    v_off, v_data = _binary_parts(values)
    k_off, k_data = _binary_parts(keys)
    base = v_off[0]
    out = v_data[base:v_off[-1]].copy()
    k_len = k_off[1:] - k_off[:-1]
    for r0, r1 in _row_chunks(v_off):
        lens = v_off[r0 + 1:r1 + 1] - v_off[r0:r1]
        m = int(lens.sum())
        if m == 0 or not k_len[r0:r1].any():
            continue
        lo = int(v_off[r0] - base)
        within = np.arange(m, dtype=np.int64) - np.repeat(v_off[r0:r1] - v_off[r0], lens)
        klen, kat = np.repeat(k_len[r0:r1], lens), np.repeat(k_off[r0:r1], lens)
        hit = klen > 0
        if hit.all():
            out[lo:lo + m] ^= k_data[kat + within % klen]
        else:
            seg = out[lo:lo + m]
            seg[hit] ^= k_data[kat[hit] + within[hit] % klen[hit]]
    rel = (v_off - base).astype(np.int32)
    res = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(rel), pa.py_buffer(out)])
    valid = pc.and_(pc.is_valid(values), pc.is_valid(keys))
    if pc.any(pc.invert(valid)).as_py():
        res = pc.if_else(valid, res, pa.scalar(None, res.type))
    return res


def byte_sum_kernel(values: pa.Array) -> pa.Array:
    """Sum of the unsigned byte values of each row (null stays null)."""
    v_off, v_data = _binary_parts(values)
    sums = np.zeros(len(values), np.int64)
    for r0, r1 in _row_chunks(v_off):      # the bytes are widened a chunk at a time
        rows = r0 + np.nonzero(v_off[r0 + 1:r1 + 1] > v_off[r0:r1])[0]             # an empty row has no byte to begin a sum at
        if rows.size:
            sums[rows] = np.add.reduceat(v_data[v_off[r0]:v_off[r1]], v_off[rows] - v_off[r0], dtype=np.int64)
    return pa.array(sums, type=pa.int64(), mask=~np.asarray(pc.is_valid(values).to_numpy(zero_copy_only=False)))


def _secret_match(plain: pa.Array, secret: pa.Array, secret_len: int = C.SECRET_LEN) -> np.ndarray:
    """More than ``secret_len`` bytes and the first ``secret_len`` equal the secret (exactly that long)."""
    n = len(plain)
    p_off, p_data = _binary_parts(plain)
    s_off, s_data = _binary_parts(secret)
    ok = (p_off[1:] - p_off[:-1] > secret_len) & (s_off[1:] - s_off[:-1] == secret_len)
    ok &= np.asarray(pc.and_(pc.is_valid(plain), pc.is_valid(secret)).to_numpy(zero_copy_only=False))
    rows = np.nonzero(ok)[0]
    if rows.size:
        span = np.arange(secret_len)
        a = p_data[p_off[rows][:, None] + span]
        b = s_data[s_off[rows][:, None] + span]
        ok[rows] = (a == b).all(axis=1)
    return ok[:n]


def _tail(arr: pa.Array, skip: int, mask: np.ndarray) -> pa.Array:
    """Bytes after the first ``skip`` of each row where ``mask`` (rows are longer than ``skip``); NULL elsewhere."""
    off, data = _binary_parts(arr)
    n = len(arr)
    start = off[:-1] + skip
    lens = np.where(mask, off[1:] - start, 0)
    new_off = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lens, out=new_off[1:])
    out = np.empty(int(new_off[-1]), np.uint8)
    for r0, r1 in _row_chunks(new_off):    # the index takes eight bytes a byte
        at = np.arange(new_off[r0], new_off[r1]) + np.repeat(start[r0:r1] - new_off[r0:r1], lens[r0:r1])
        out[new_off[r0]:new_off[r1]] = data[at]
    valid = pa.array(mask).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(new_off.astype(np.int32)), pa.py_buffer(out)],
                                 null_count=int(n - mask.sum()))


def auth_kernel(decoded: pa.Array, cipher: pa.Array, secret: pa.Array, prev_cipher: pa.Array,
                prev_secret: pa.Array, body_offset: int = C.BODY_OFFSET) -> pa.StructArray:
    """Try the current key, then (only on rows that failed) the previous one; one pass per batch.

    Returns ``struct<code int, body binary>``: code 1 = current key, 2 =
    previous key, 0 = neither; body = bytes after the secret and separator.
    """
    n = len(decoded)
    cur = xor_kernel(decoded, cipher)
    ok_cur = _secret_match(cur, secret)
    code = np.where(ok_cur, 1, 0).astype(np.int32)
    body = _tail(cur, body_offset, ok_cur)
    retry = ~ok_cur & np.asarray(pc.and_(pc.is_valid(decoded), pc.is_valid(prev_cipher)).to_numpy(zero_copy_only=False))
    idx = np.nonzero(retry)[0]
    if idx.size:
        take = pa.array(idx)
        sub = xor_kernel(pc.take(decoded, take), pc.take(prev_cipher, take))
        ok_prev = _secret_match(sub, pc.take(prev_secret, take))
        hit = idx[ok_prev]
        if hit.size:
            code[hit] = 2
            # scatter the previous-key bodies back to their rows (others point at a trailing null)
            where = np.full(n, len(sub), dtype=np.int64)
            where[idx] = np.arange(len(sub))
            padded = pa.concat_arrays([_tail(sub, body_offset, ok_prev), pa.nulls(1, pa.binary())])
            prev_body = pc.take(padded, pa.array(where))
            body = pc.if_else(pa.array(code == 2), prev_body, body)
    return pa.StructArray.from_arrays([pa.array(code, pa.int32()), body], names=["code", "body"])


@arrow_udf(T.StructType([T.StructField("code", T.IntegerType()), T.StructField("body", T.BinaryType())]))
def _auth_udf(decoded: pa.Array, cipher: pa.Array, secret: pa.Array, prev_cipher: pa.Array,
              prev_secret: pa.Array) -> pa.Array:
    return auth_kernel(decoded, cipher, secret, prev_cipher, prev_secret)


_auth_once = _auth_udf.asNondeterministic()


def xor_authenticate(decoded, cipher, secret, prev_cipher, prev_secret) -> Column:
    """R1 + P3 + P4 in one Arrow pass: ``struct<code, body>`` (1 current key, 2 previous key, 0 neither)."""
    return _auth_once(*[_col(c).cast("binary") for c in (decoded, cipher, secret, prev_cipher, prev_secret)])


@arrow_udf(T.BinaryType())
def _xor_udf(values: pa.Array, keys: pa.Array) -> pa.Array:
    return xor_kernel(values, keys)


@arrow_udf(T.LongType())
def _byte_sum_udf(values: pa.Array) -> pa.Array:
    return byte_sum_kernel(values)


# Marked non-deterministic only so the optimizer never copies the call into a
# later filter and the projection both (it would then run twice per row); the
# function itself is a pure byte XOR, so task retries give the same bytes.
_xor_once = _xor_udf.asNondeterministic()


def xor_bytes(value, key) -> Column:
    """XOR(value, key) on bytes; strings are taken as their UTF-8 bytes."""
    return _xor_once(_col(value).cast("binary"), _col(key).cast("binary"))


_byte_sum_once = _byte_sum_udf.asNondeterministic()


def byte_sum(value) -> Column:
    """Checksum: sum of the (unsigned) byte codes of the UTF-8 bytes (evaluated once per row, see XOR)."""
    return _byte_sum_once(_col(value).cast("binary"))


def xor_bytes_native(value, key) -> Column:
    """Pure-SQL XOR with higher-order functions.  Correct but slow: tests only."""
    v = F.hex(_col(value).cast("binary"))
    k = F.hex(_col(key).cast("binary"))
    n = (F.length(v) / 2).cast("int")
    kl = (F.length(k) / 2).cast("int")

    def one(i):
        vb = F.conv(v.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        kb = F.conv(k.substr(F.pmod(i, F.greatest(kl, F.lit(1))) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        x = F.when(kl == 0, vb).otherwise(vb.bitwiseXOR(kb))
        return F.lpad(F.hex(x), 2, "0")

    body = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)
    return F.when(n == 0, F.lit(b"").cast("binary")).otherwise(F.unhex(F.array_join(body, "")))
