import numpy as np
import pytest
from helpers import SF001, table
from pyspark.sql import functions as F

from feedspark.llm import whitening
from feedspark.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(vectors, k=16):
    """Exact integers, then numpy on the centred fit list."""
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1000000
    u = np.unique(x, axis=0)
    n, s = len(u), [int(v) for v in u.sum(axis=0)]
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    y = u.astype(object) * n - np.array(s, object)
    v = (y.T @ y).astype(float) / float(n) ** 3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    z = (x.astype(object) * n - np.array(s, object)).astype(float) / n @ vectors / np.sqrt(values)
    return n, deviation, z, values / np.trace(v)


def same(rows, ids, vectors, k=16):
    n, deviation, z, explained = brute(vectors, k)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {n}
    sign = np.ones(k)
    for i, v in enumerate(ids):
        mine = np.array([got[v][c + 1].whitened for c in range(k)])
        if i == 0:
            sign = np.where(np.sign(mine) == np.sign(z[0]), 1, -1)
        assert np.allclose(mine, sign * z[i], rtol=1e-7, atol=1e-8)
        assert {int(got[v][c + 1].deviation) for c in range(k)} == {deviation[i]}
        assert np.allclose([got[v][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query_against_brute_force(spark):
    rows = [r for r in table(spark, SF001, "embeddings").collect()
            if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    out = op13_whitening(spark, SF001)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    same(out.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_copies_weigh_once_and_bad_rows_go(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5)) * [9, 5, 3, 2, 1]
    vectors = [*base, *[base[0]] * 60, *(base[1:4] + 1e-9)]                # a third of all rows is one vector
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    bad = [(900, None, 0), (901, [1.0, None, 1.0, 1.0, 1.0], 0), (902, [float("nan")] * 5, 0), (903, [float("inf")] + [0.0] * 4, 0),
           (904, [], 0), (905, [1.0, 2.0], 0), (906, [1e300] * 5, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(7)
    for c in ("_x", "_dim", "n", "component", "whitened", "_vec"):
        df = df.withColumn(c, F.lit("x"))
    same(whitening.whiten(df).collect(), [r[0] for r in rows], vectors, 5)


def test_constant_and_single_vectors(spark):
    rows = [(1, [1.0, 7.0], 0), (2, [2.0, 7.0], 0), (2, [2.0, 7.0], 0), (None, [5.0, 7.0], 0)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 8 and sorted(str(r.vec_id) for r in out if r.component == 1) == ["1", "2", "2", "None"]
    assert all((r.whitened is None) == (r.component == 2) and r.explained == 2 - r.component for r in out)
    out = whitening.whiten(spark.createDataFrame([(9, [3.0, 4.0], 0)] * 3, SCHEMA)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, None, 0.0, 0.0)] * 6


def test_empty(spark):
    for rows in ([], [(1, None, 0), (2, [], 0)]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("scale", [1, 100, 1 << 20, 1 << 35])
def test_sums_are_exact_at_any_width(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, size=(2500, 4))
    assert (whitening.unpack(whitening.pack(x), 4) == x).all()
    n, sums = 10**9, [int(v) for v in x.sum(axis=0)]
    y = whitening.centred(x, n, sums)
    want = [[n * int(c) - s for c, s in zip(row, sums)] for row in x]
    assert y.tolist() == want
    got = {}
    whitening.pair_sums(y, got)
    assert got == {(i, j): sum((r[i] + (r[j] if i < j else 0)) ** 2 for r in want) for i in range(4) for j in range(i, 4)}
    assert whitening.square_sums_by_row(y) == [sum(c * c for c in r) for r in want]


def test_equal_vectors_have_equal_bytes():
    x = np.array([[0, 0], [1, -127], [127, 128], [-32767, 0], [1 << 31, 0], [0, 0]])
    assert len(set(whitening.pack(x))) == 5 and whitening.pack(x)[0] == whitening.pack(x[:1])[0]
