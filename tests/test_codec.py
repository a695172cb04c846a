import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feedspark.functions.codec import (
    b64_decode_lenient, b64_encode, byte_sum, byte_sum_kernel, xor_bytes, xor_bytes_native, xor_kernel,
)


def _py_xor(v: bytes, k: bytes) -> bytes:
    if not k:
        return v
    return bytes(b ^ k[i % len(k)] for i, b in enumerate(v))


def test_lenient_base64_edge_rows(spark):
    rows = [("aGVsbG8=", "hello"), ("aGVsbG8", "hello"), ("aGVsbG8=junk", "hello"), ("aGVsbG8\n", "hello"),
            ("aGVs!bG8=", "hel"), ("aGVsb", "hel"), ("", ""), ("a", "")]
    df = spark.createDataFrame(rows, "s string, want string")
    got = df.select("want", b64_decode_lenient("s").cast("string").alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_encode_is_one_line(spark):
    r = spark.range(1).select(b64_encode(F.expr("repeat('x', 500)")).alias("e")).first()
    assert len(r.e) == 668 and "\n" not in r.e and "\r" not in r.e
    assert base64.b64decode(r.e) == b"x" * 500


def test_xor_kernel_edges():
    vals = [b"", b"abc", bytes(range(256)) * 3, b"\xff\x80\x7f", None, b"zz"]
    keys = [b"k", b"", b"key!", b"\x01", b"x", None]
    out = xor_kernel(pa.array(vals, pa.binary()), pa.array(keys, pa.binary())).to_pylist()
    for v, k, o in zip(vals, keys, out):
        if v is None or k is None:
            assert o is None
        else:
            assert o == _py_xor(v, k)


def test_xor_kernel_sliced_and_chunked(monkeypatch):
    import feedspark.functions.codec as codec

    monkeypatch.setattr(codec, "_CHUNK_BYTES", 7)
    rng = np.random.default_rng(1)
    vals = [rng.bytes(int(n)) for n in rng.integers(0, 40, 50)]
    keys = [rng.bytes(int(n)) for n in rng.integers(0, 5, 50)]
    va, ka = pa.array(vals, pa.binary()).slice(3), pa.array(keys, pa.binary()).slice(3)
    out = codec.xor_kernel(va, ka).to_pylist()
    assert out == [_py_xor(v, k) for v, k in zip(vals[3:], keys[3:])]


def test_byte_sum_kernel():
    vals = [b"", b"\xff\x01", "é".encode(), None]
    assert byte_sum_kernel(pa.array(vals, pa.binary())).to_pylist() == [0, 256, 0xC3 + 0xA9, None]


def test_xor_udf_matches_native_and_python(spark):
    rows = [(bytes(range(256)) * 2, b"key"), (b"", b""), (b"abc", b""), (b"\xff\x80", b"\x01")]
    df = spark.createDataFrame(rows, "v binary, k binary")
    got = df.select("v", "k", xor_bytes("v", "k").alias("a"), xor_bytes_native("v", "k").alias("b"),
                    byte_sum("v").alias("s")).collect()
    for r in got:
        assert bytes(r.a) == bytes(r.b) == _py_xor(bytes(r.v), bytes(r.k))
        assert r.s == sum(bytes(r.v))


def test_xor_over_row_chunks(monkeypatch):
    import feedspark.functions.codec as codec

    rng = np.random.default_rng(4)
    vals = [rng.bytes(int(n)) for n in rng.integers(0, 300, 400)]
    pool = [b"", b"a", b"k0cipher00", bytes(range(200, 256)), None]
    keys = [pool[int(i)] for i in rng.integers(0, len(pool), 400)]
    va, ka = pa.array(vals, pa.binary()).slice(5), pa.array(keys, pa.binary()).slice(5)
    whole = codec.xor_kernel(va, ka)
    monkeypatch.setattr(codec, "_CHUNK_BYTES", 700)
    assert codec.xor_kernel(va, ka).equals(whole)
    want = [None if k is None else _py_xor(v, k) for v, k in zip(vals[5:], keys[5:])]
    assert whole.to_pylist() == want


def test_auth_kernel_current_previous_and_failures():
    from feedspark.functions.codec import auth_kernel

    cur, sec, old, osec = b"curcipher0", b"cursecret0", b"Zq9-older7", b"prevsecret"
    dec = [_py_xor(sec + b"^a^1^m", cur), _py_xor(osec + b"^b^2^m", old), _py_xor(b"nosecret00^c", cur),
           _py_xor(sec, cur), None, _py_xor(sec + b"^", cur), _py_xor(osec + b"^zz", old)]
    n = len(dec)
    r = auth_kernel(pa.array(dec, pa.binary()), pa.array([cur] * n), pa.array([sec] * n),
                    pa.array([old] * (n - 1) + [None]), pa.array([osec] * n)).to_pylist()
    assert [x["code"] for x in r] == [1, 2, 0, 0, 0, 1, 0]
    assert [x["body"] for x in r] == [b"a^1^m", b"b^2^m", None, None, None, b"", None]


def test_kernels_need_little_more_than_their_batch():
    import tracemalloc

    from feedspark.functions.codec import byte_sum_kernel, xor_kernel

    texts = pa.array([b"\xff" * 50_000, None, b"", b"\x01\x02"] * 600 + [b""], pa.binary())
    keys = pa.array([b"ab"] * len(texts), pa.binary())
    size = 50_002 * 600
    for run, most in ((lambda: byte_sum_kernel(texts), size), (lambda: xor_kernel(texts, keys), 3 * size)):
        tracemalloc.start()
        got = run()
        assert tracemalloc.get_traced_memory()[1] < most
        tracemalloc.stop()
    assert byte_sum_kernel(texts).to_pylist() == [255 * 50_000, None, 0, 3] * 600 + [0] and len(got) == len(texts)


def test_auth_kernel_needs_little_more_than_its_batch(monkeypatch):
    import tracemalloc

    import feedspark.functions.codec as codec

    cur, sec, old, osec = b"curcipher0", b"cursecret0", b"Zq9-older7", b"prevsecret"
    rng = np.random.default_rng(5)
    bodies = [rng.bytes(int(n)) for n in rng.integers(0, 10_000, 3000)]
    plain = [{0: osec, 1: b"nosecret00"}.get(i % 7, sec) + b"^" + b for i, b in enumerate(bodies)]
    n = len(plain)
    dec = codec.xor_kernel(pa.array(plain, pa.binary()), pa.array([old if i % 7 == 0 else cur for i in range(n)], pa.binary()))
    args = [dec, *(pa.array([x] * n, pa.binary()) for x in (cur, sec, old, osec))]
    tracemalloc.start()
    got = codec.auth_kernel(*args)
    assert tracemalloc.get_traced_memory()[1] < 6 * dec.nbytes
    tracemalloc.stop()
    assert got.field("code").to_pylist() == [{0: 2, 1: 0}.get(i % 7, 1) for i in range(n)]
    assert got.field("body").to_pylist() == [None if i % 7 == 1 else b for i, b in enumerate(bodies)]
    monkeypatch.setattr(codec, "_CHUNK_BYTES", 700)
    assert codec.auth_kernel(*args).equals(got)
