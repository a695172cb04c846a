"""Property tests (hypothesis) on the pure kernels: no Spark needed, so many cases are cheap."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from feedspark.functions.codec import auth_kernel, byte_sum_kernel, xor_kernel
from feedspark.streaming.gaps import absorb

blobs = st.binary(min_size=0, max_size=300)
keys = st.binary(min_size=0, max_size=16)


def _py_xor(v, k):
    return v if not k else bytes(b ^ k[i % len(k)] for i, b in enumerate(v))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(blobs, keys), min_size=1, max_size=40))
def test_xor_roundtrip_and_reference(rows):
    v = pa.array([r[0] for r in rows], pa.binary())
    k = pa.array([r[1] for r in rows], pa.binary())
    once = xor_kernel(v, k)
    assert once.to_pylist() == [_py_xor(a, b) for a, b in rows]
    assert xor_kernel(once, k).to_pylist() == [r[0] for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(blobs, min_size=1, max_size=40))
def test_byte_sum(rows):
    assert byte_sum_kernel(pa.array(rows, pa.binary())).to_pylist() == [sum(r) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["cur", "prev", "bad"]), st.binary(max_size=40)), min_size=1, max_size=30))
def test_auth_matches_plain_rules(rows):
    cur, sec, old, osec = b"c1-key-abc", b"secret-one", b"c0-key-xyz", b"secret-old"
    dec, want = [], []
    for kind, body in rows:
        if kind == "cur":
            dec.append(_py_xor(sec + b"^" + body, cur)), want.append((1, body))
        elif kind == "prev":
            dec.append(_py_xor(osec + b"^" + body, old)), want.append((2, body))
        else:
            dec.append(_py_xor(b"wrong-pass^" + body, cur)), want.append((0, None))
    n = len(rows)
    got = auth_kernel(pa.array(dec, pa.binary()), pa.array([cur] * n), pa.array([sec] * n),
                      pa.array([old] * n), pa.array([osec] * n)).to_pylist()
    assert [(g["code"], g["body"]) for g in got] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=60), min_size=1, max_size=6))
def test_received_plus_missing_is_full_range(batches):
    mn = mx = None
    los = his = np.zeros(0, np.int64)
    for b in batches:
        mn, mx, los, his, *_ = absorb(mn, mx, los, his, np.asarray(b, np.int64))
    seen = {x for b in batches for x in b}
    missing = {x for lo, hi in zip(los.tolist(), his.tolist()) for x in range(lo, hi + 1)}
    if not seen:
        assert mn is None and not missing
        return
    assert not (missing & seen)
    assert missing | seen == set(range(min(seen), max(seen) + 1))
