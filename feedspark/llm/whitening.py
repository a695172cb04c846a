"""Whitening of embeddings with covariances from squares alone (polarisation).

Every entry becomes an integer, so all sums are exact.  Of the centred vectors
y = n * x - S only squares are aggregated: of every dimension, and of the sum
of every pair of dimensions.  Half the difference of a pair's sum and its two
dimensions' sums is the pair's cross product; over n^3 it is the covariance.
The matrix that is assembled from them is as large as the vectors are long, so
its eigenvectors are found on the driver; rows are whitened where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import materialize

STEPS = 64                                 # integer steps per unit
MOST = 1 << 40                             # an entry beyond this many steps either way is no usable number
COMPONENTS = 16
ZERO = 1e-13                               # an eigenvalue below this share of the largest is none
_ROWS = 1024                               # rows per numpy pass
_HALF = 26                                 # bits of the lower half of a split integer
_SPLIT = 1 << 2 * _HALF - 1                # integers up to here have halves whose products sum up exactly over _ROWS rows
_SUMS = "i int, j int, q decimal(38,0)"


# ---- integer vectors as bytes: as narrow as their entries allow, so equal vectors have equal bytes -------------
def pack(x: np.ndarray) -> list[bytes]:
    """Rows of an integer matrix as bytes: the width of an entry, then the entries in that width."""
    top = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for width, least, most in ((1, -1, 127), (2, 127, 32767), (4, 32767, 2**31 - 1), (8, 2**31 - 1, 2**62)):
        at = np.flatnonzero((top > least) & (top <= most))
        raw = np.ascontiguousarray(x[at].astype(f"<i{width}")).view(np.uint8).reshape(len(at), width * x.shape[1])
        for i, row in zip(at, raw):
            out[i] = bytes([width]) + row.tobytes()
    return out


def unpack(rows: Iterable[bytes], dim: int) -> np.ndarray:
    """The integer matrix that ``pack`` made the rows from."""
    rows = list(rows)
    out = np.zeros((len(rows), dim), np.int64)
    widths = np.array([r[0] for r in rows], np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{width}").reshape(len(at), dim)
    return out


# ---- exact arithmetic ------------------------------------------------------------------
def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits if they hold it, else in Python integers."""
    top = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if top < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(w: np.ndarray, axis: int = 0) -> list[int]:
    """Exact sums of squares of integers along an axis of at most ``_ROWS`` entries."""
    if w.dtype == object or int(np.abs(w).max(initial=0)) >= _SPLIT:
        return [int(v) for v in (w.astype(object) ** 2).sum(axis=axis)]
    high, low = w >> _HALF, w & ((1 << _HALF) - 1)
    parts = (high * high).sum(axis=axis), (high * low).sum(axis=axis), (low * low).sum(axis=axis)
    return [(int(a) << 2 * _HALF) + (int(b) << _HALF + 1) + int(c) for a, b, c in zip(*parts)]


def pair_sums(y: np.ndarray, into: dict[tuple[int, int], int]) -> None:
    """Adds the sums of squares of every column (i, i) and of the sum of every two columns (i, j)."""
    dim = y.shape[1]
    for at in range(0, len(y), _ROWS):
        part = y[at:at + _ROWS]
        for i in range(dim):
            w = part[:, i:].copy()
            w[:, 1:] += part[:, i:i + 1]
            for j, q in enumerate(square_sums(w), i):
                into[i, j] = into.get((i, j), 0) + q


class Model(NamedTuple):
    """Fit list size, sums per dimension, eigenvalues (falling), projections (dimension x component, divided by n * sqrt(e)), shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    project: np.ndarray                    # NaN where the eigenvalue is nothing
    explained: np.ndarray


def assemble(n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int) -> Model:
    """Covariances by polarisation, then eigenvectors; each vector's largest entry is positive."""
    dim = len(sums)
    cube = n**3
    v = np.empty((dim, dim))
    for i in range(dim):
        v[i, i] = squares[i, i] / cube     # division of integers rounds correctly
        for j in range(i + 1, dim):
            v[i, j] = v[j, i] = float(Fraction(squares[i, j] - squares[i, i] - squares[j, j], 2 * cube))
    trace = sum(squares[i, i] for i in range(dim)) / cube
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > ZERO * max(values[0], 0.0), values, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        project = np.where(values > 0, vectors / n / np.sqrt(values), np.nan)
    return Model(n, sums, values, project, values / trace if trace > 0 else np.zeros_like(values))


# ---- Spark -------------------------------------------------------------------------------
def _quantised(rows: DataFrame, vec: str) -> DataFrame:
    """``rows`` with ``_dim`` and ``_x`` (packed steps) of every usable vector, in place of the vector."""
    v = F.col(vec).cast("array<double>")
    inf = float("inf")
    sound = F.forall(v, lambda c: F.coalesce((c > -inf) & (c < inf) & (F.abs(c) <= MOST / STEPS), F.lit(False)))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        size = vectors.map(len).to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            out.iloc[at] = pack(np.floor(np.stack(vectors.iloc[at].to_list()) * STEPS).astype(np.int64))
        return out

    held = rows.where(F.coalesce(sound & (F.size(v) > 0), F.lit(False)))
    return held.withColumns({"_dim": F.size(v), "_x": packed(v)}).drop(vec)


def _partials(fit: DataFrame, dim: int, schema: str, of) -> DataFrame:
    """``of(batches of integer matrices)`` yields rows, once per task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(list(of(unpack(b["_x"], dim) for b in batches if len(b))), columns=[c.split()[0] for c in schema.split(", ")])

    return fit.select("_x").mapInPandas(run, schema)


def fit_model(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct packed vectors ``_x``; None if there are none.  The driver gets dim^2 / 2 sums."""
    def totals(matrices):
        n, sums = 0, [0] * dim
        for x in matrices:
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
        return [(i, i, Decimal(s)) for i, s in enumerate(sums)] + [(-1, -1, Decimal(n))]

    def summed(rows: DataFrame) -> dict[tuple[int, int], int]:
        return {(r.i, r.j): int(r.q) for r in rows.groupBy("i", "j").agg(F.sum("q").cast("decimal(38,0)").alias("q")).collect()}

    first = summed(_partials(fit, dim, _SUMS, totals))
    n = first.get((-1, -1), 0)
    if not n:
        return None
    sums = [first[i, i] for i in range(dim)]

    def squares(matrices):
        into: dict[tuple[int, int], int] = {}
        for x in matrices:
            pair_sums(centred(x, n, sums), into)
        return [(i, j, Decimal(q)) for (i, j), q in into.items()]

    return assemble(n, sums, summed(_partials(fit, dim, _SUMS, squares)), components)


def identity_error(fit: DataFrame, dim: int, model: Model) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), over the components that there are."""
    live = np.flatnonzero(model.values > 0)

    def products(matrices):
        total, cross = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for x in matrices:
            z = centred(x, model.n, model.sums).astype(float) @ model.project[:, live]
            total += z.sum(axis=0)
            cross += z.T @ z
        return [(-1, j, float(t)) for j, t in enumerate(total)] + [(i, j, float(c)) for (i, j), c in np.ndenumerate(cross)]

    if not len(live):
        return 0.0
    got = {(r.i, r.j): r.q / model.n for r in _partials(fit, dim, "i int, j int, q double", products).groupBy("i", "j").agg(F.sum("q").alias("q")).collect()}
    mean = np.array([got[-1, j] for j in range(len(live))])
    cov = np.array([[got[i, j] for j in range(len(live))] for i in range(len(live))]) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Usable are vectors without null or non-finite entries, none beyond 2^40
    steps, that have the length most of them have (ties: the greater length);
    null, empty and other vectors take no part.  The fit list is every distinct
    vector of steps once, so repeated rows weigh nothing and each comes back
    whitened; a null id stays null.  Components are numbered from 1 by falling
    eigenvalue, as many as ``components`` or dimensions.  Where the eigenvalue
    is nothing (a constant dimension, too few distinct vectors) ``whitened`` is
    null and ``explained`` 0.  ``deviation`` is decimal(38,0); null if it has
    more digits.  An empty table, or one without usable vectors, gives no
    rows.  Other columns are not looked at.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    held = materialize(_quantised(rows.select(id_col, F.col(vec).alias("_vec")), "_vec"), "steps", spark)
    sizes = held.groupBy("_dim").count().orderBy(F.desc("count"), F.desc("_dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["_dim"]
    held = held.where(F.col("_dim") == dim).drop("_dim")
    fit = materialize(held.select("_x").distinct(), "fit_list", spark)
    model = fit_model(fit, dim, components)
    error = identity_error(fit, dim, model)
    k = len(model.values)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                rows_here = part.num_rows
                y = centred(unpack(part.column("_x").to_pylist(), dim), model.n, model.sums)
                off = [Decimal(d) if d < 10**38 else None for d in square_sums_by_row(y)]
                z = (y.astype(float) @ model.project).ravel()
                each = pa.array(np.repeat(np.arange(rows_here), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                    pa.array(np.full(rows_here * k, model.n, np.int64)), pa.array(off, pa.decimal128(38, 0)).take(each),
                    pa.array(z, mask=np.isnan(z)), pa.array(np.tile(model.explained, rows_here)), pa.array(np.full(rows_here * k, error)),
                ], names=names)

    return held.mapInArrow(run, schema)


def square_sums_by_row(y: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    out = [0] * len(y)
    for at in range(0, y.shape[1], _ROWS):
        out = [a + b for a, b in zip(out, square_sums(y[:, at:at + _ROWS], axis=1))]
    return out
