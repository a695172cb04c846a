import math

import numpy as np
from helpers import SF001, SF01, table
from pyspark.sql import functions as F

from feedspark.llm import ann




def brute(rows, k):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)
            and any(v)}
    out = []
    for q, a in good:
        if q % 50:
            continue
        hits = []
        for i, b in good:
            if i != q and len(a) == len(b):
                s = ann.cosine(np.array([a]), np.array([b]))[0]
                hits.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def run(df, k=5):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k).collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (None, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (9, [-1.0, 0.5]), (10, [1.0, 0.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(2), "dim": F.lit(3)})
    assert run(df) == brute(rows, 5)
    assert run(df.where("false")) == []


def test_recall_is_whole_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 60)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 3)
    for sf in (SF001, SF01):
        df = table(spark, sf, "embeddings")
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        got, want = run(df), brute(rows, 5)
        assert len(got) == len(want)
        assert len({x[:3] for x in got} & {x[:3] for x in want}) >= 0.99 * len(want)


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(3)
    for dim in (3, 64, 100):
        x = rng.standard_normal((2000, dim))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        code, fit, blur = ann.encode(unit)
        codes, turned = code.view("<u8"), unit @ ann.rotation(dim)
        assert np.allclose(np.linalg.norm(turned, axis=1), 1)
        est, width = ann.estimate(turned[:40], codes, fit, blur)
        true = unit[:40] @ unit.T
        assert (np.abs(est - true) <= width).mean() > 0.995
        assert np.abs(est - true).mean() < 3 / np.sqrt(dim * ann.BITS_PER_DIM)


def test_vectors_of_extreme_lengths_take_part(spark):
    """Squares that over- or underflow: the cosine is that of the direction."""
    base = [[3.0, 4.0], [4.0, 3.0], [-3.0, 4.0], [5.0, 0.1]]
    scales = [1.0, 1e200, 1e-200, 1e307, 1e-320]
    rows = [(i * len(base) + j, [c * s for c in v]) for i, s in enumerate(scales) for j, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=len(rows)).collect()
    assert len(got) == len(rows) - 1
    for r in got:
        v = base[r.vec_id % len(base)]
        want = (3 * v[0] + 4 * v[1]) / 5 / (v[0] ** 2 + v[1] ** 2) ** 0.5
        assert abs(r.score - want) < (1e-3 if r.vec_id >= 16 else 1e-12)     # the last scale is subnormal: few digits are left
