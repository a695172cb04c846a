"""Nearest neighbours by randomly rotated one-bit codes.

Index: every vector is scaled to length one, padded with zeros to
``BITS_PER_DIM`` times its length and rotated by a random orthogonal matrix; the
signs of its coordinates, packed into bytes, are its code.  (Longer codes have
narrower error bounds.)  With it go two correction scalars: ``fit``, the inner
product of the vector and its code, and the error scale that follows from it.
Search: the rotated query is rounded to a few bits per coordinate, one bit
plane at a time is matched against the packed codes by AND and popcount, and
code . query / fit estimates the cosine.  A candidate is computed exactly if
its upper bound reaches the k-th largest lower bound of its query; the rest
cannot be among the nearest (but for the chance that the error bound,
``EPSILON`` standard units wide, fails).

Queries and rows are dealt into blocks by hash; one task group compares one
query block with one row block and returns at most k rows per query.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedspark.llm.common import materialize, part_count

EPSILON = 3.0                              # width of the error bound; the chance of a miss falls as exp(-EPSILON^2 / 2)
PLANES = 4                                 # bits per rotated query coordinate
BITS_PER_DIM = 8                           # bits of a code per coordinate of the vector
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 1024
_INDEX = "vec_id bigint, dim int, vec array<double>, code binary, fit double, blur double"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """What a random rotation of the padded space does to the first ``dim`` coordinates (dim x code bits); the same in every task."""
    bits = dim * BITS_PER_DIM + -dim * BITS_PER_DIM % 64     # whole 64-bit words
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (bytes), fit and blur of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    bits = turned.shape[1]
    fit = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    blur = np.sqrt(np.maximum(0.0, 1 - fit * fit)) / fit / np.sqrt(bits - 1)
    return np.packbits(turned > 0, axis=1, bitorder="little"), fit, blur


def _usable(vec: Column) -> Column:
    """No null or non-finite component, and one that is not zero."""
    inf = float("inf")
    sound = F.forall(vec, lambda x: F.coalesce((x > -inf) & (x < inf), F.lit(False)))
    return F.coalesce(sound & F.exists(vec, lambda x: x != 0), F.lit(False))


def _scaled(vec: Column) -> Column:
    """The vector, divided by a power of two if its squared length is near the ends of the double range; cosines stay as they are."""
    length = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)
    power = F.floor(F.log2(F.array_max(F.transform(vec, F.abs)))).cast("double")
    half = F.floor(power / 2).cast("double")           # in two steps, each of which is a finite double
    smaller = F.transform(vec, lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power))
    return F.when((length > 1e-200) & (length < 1e200), vec).otherwise(smaller)


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Usable (vec_id, vec) rows; equal rows count once, rows without an id take no part."""
    v = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where(F.col("vec_id").isNotNull() & _usable(F.col("vec"))).distinct()
    return v.withColumn("vec", _scaled(F.col("vec")))


def _code(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for dim, part in pdf.groupby(pdf["vec"].map(len), sort=False):
        x = np.stack(part["vec"].to_numpy()).astype(np.float64)
        code, fit, blur = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
        out.append(pd.DataFrame({"vec_id": part["vec_id"], "dim": np.int32(dim), "vec": part["vec"],
                                 "code": [c.tobytes() for c in code], "fit": fit, "blur": blur}))
    return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "dim": [], "vec": [], "code": [], "fit": [], "blur": []})


def index(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, dim, vec, code (packed signs), fit and blur (correction scalars)."""
    return vectors(table, id_col, vec_col).mapInPandas(lambda it: map(_code, it), _INDEX)


def estimate(turned: np.ndarray, codes: np.ndarray, fit: np.ndarray, blur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine estimates and error widths for rotated unit queries against packed codes (uint64 words).

    The query is low + step * level with a ``PLANES``-bit level per coordinate, so
    signs . query = 2 * (low * popcount(code) + step * sum_p 2^p popcount(code & plane_p)) - sum(query).
    """
    n, bits = turned.shape
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint32)
    rounded = low[:, None] + step[:, None] * level
    planes = [np.packbits((level >> p & 1).astype(bool), axis=1, bitorder="little").view("<u8") for p in range(PLANES)]
    weighted = np.zeros((n, len(codes)), np.uint32)
    for p, plane in enumerate(planes):
        for w in range(codes.shape[1]):
            weighted += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint32) << np.uint32(p)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    signed = 2 * (low[:, None] * ones[None, :] + step[:, None] * weighted) - rounded.sum(axis=1)[:, None]
    rounding = np.linalg.norm(rounded - turned, axis=1) / np.sqrt(bits)
    width = EPSILON * (blur[None, :] + rounding[:, None] / fit[None, :]) + 1e-12
    return signed / np.sqrt(bits) / fit[None, :], width


def _sum_by_coordinate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed coordinate by coordinate: equal rows give equal sums wherever they stand."""
    a, b, out = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.zeros(len(a))
    for x, y in zip(a, b):
        out += x * y
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision."""
    return np.clip(_sum_by_coordinate(a, b) / np.sqrt(_sum_by_coordinate(a, a) * _sum_by_coordinate(b, b)), -1.0, 1.0)


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    q, x = np.stack(queries["vec"].to_numpy()), np.stack(rows["vec"].to_numpy())
    q_id, x_id = queries["vec_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    codes = np.frombuffer(b"".join(rows["code"]), "<u8").reshape(len(rows), -1)
    turned = q / np.linalg.norm(q, axis=1, keepdims=True) @ rotation(q.shape[1])
    est, width = estimate(turned, codes, rows["fit"].to_numpy(), rows["blur"].to_numpy())
    own = q_id[:, None] == x_id[None, :]
    low = np.where(own, -np.inf, est - width)
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    qi, xi = np.nonzero((est + width >= floor[:, None]) & ~own)
    score, qq, xx = np.empty(len(qi)), _sum_by_coordinate(q, q), _sum_by_coordinate(x, x)
    for at in range(0, len(qi), 1 << 15):  # rerank in pieces of bounded memory
        s = slice(at, at + (1 << 15))
        dot = _sum_by_coordinate(q[qi[s]], x[xi[s]])
        score[s] = np.clip(dot / np.sqrt(qq[qi[s]] * xx[xi[s]]), -1.0, 1.0)
    order = np.lexsort((x_id[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.searchsorted(qi, qi)
    best = np.arange(len(qi)) - first < k
    return pd.DataFrame({"query_id": q_id[qi[best]], "vec_id": x_id[xi[best]], "score": score[best]})


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by cosine, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id.  A query is not its own candidate.
    Rows that are null, zero, or hold null or non-finite components take no
    part; neither do rows without an id.  Equal rows count once; different
    vectors under one id stay separate rows.  Vectors meet only vectors of
    their own dimension.  An empty table gives no rows; other columns of
    ``table`` are not read.
    """
    coded = materialize(index(table, id_col, vec_col), "codes")
    marked = coded.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, n_q = marked.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("int"))).first()
    blocks, q_blocks = part_count(n, ROWS_PER_BLOCK), part_count(n_q, QUERIES_PER_BLOCK)
    dealt = marked.withColumns({
        "block": F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int"),
        "q_block": F.pmod(F.xxhash64("vec", "vec_id"), F.lit(q_blocks)).cast("int"),
    })
    queries = dealt.where("is_query").select(
        "vec_id", "vec", "dim", "q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = dealt.select("vec_id", "vec", "code", "fit", "blur", "dim", "block",
                        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    cell = ["dim", "q_block", "block"]
    found = queries.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(
        lambda q, x: _search(q, x, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
