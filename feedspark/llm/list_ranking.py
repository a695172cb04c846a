"""Distributed list ranking: prefix sums along a linked list, by contraction.

Every round numbers the list's elements by id and cuts them into blocks of a
fixed size.  A task takes a block and folds every stretch of the list that
stays inside it onto the stretch's first element, by pointer doubling over
arrays; the stretches are the next round's list.  If ids follow the list only
loosely, so that a round folds little, elements that draw heads also fold
successors that draw tails, which leaves three quarters of any list.  The
rounds end when one element is left; positions then go back down round by
round, each by one join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import materialize
from feedspark.operators.numbering import number_rows

BLOCK = 1 << 15                            # elements per task of a round
_LIST = ("id", "next", "n")


def fold_stretches(ids: np.ndarray, nexts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per element: the index of its stretch's first and last element, and the sums of the weights before and up to it in the stretch."""
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids, nexts, sorter=order).clip(max=len(ids) - 1)
    succ = np.where(ids[order[at]] == nexts, order[at], -1)
    none = len(ids)                        # a place for "no element", which points to itself
    pred = np.full(none + 1, none)
    pred[succ[succ >= 0]] = np.flatnonzero(succ >= 0)
    total = np.vstack([weights, np.zeros((1, weights.shape[1]), np.int64)])
    first = np.append(np.arange(none), none)
    while (pred[:none] < none).any():
        live = pred < none
        first[live] = first[pred[live]]
        total = total + total[pred]
        pred = pred[pred]
    last = np.empty(none + 1, np.int64)
    tail = np.flatnonzero(succ < 0)
    last[first[tail]] = tail
    first = first[:none]
    return first, last[first], total[:none] - weights, total[:none]


def _contract(parts: DataFrame, weights: list[str]) -> DataFrame:
    """Level table of a list with column ``block``: every element with its head and the sums before it; heads with what they stand for."""
    sums = [f"w_{w}" for w in weights]
    schema = ", ".join(["id bigint, head bigint", *[f"before_{w} bigint" for w in weights], "next bigint", *[f"{w} bigint" for w in sums]])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nexts = pdf["id"].to_numpy(np.int64), pdf["next"].to_numpy(np.int64)
        first, last, before, upto = fold_stretches(ids, nexts, pdf[sums].to_numpy(np.int64))
        out = pd.DataFrame({"id": ids, "head": ids[first]})
        for k, w in enumerate(weights):
            out[f"before_{w}"] = before[:, k]
        out["next"] = nexts[last]
        for k, w in enumerate(sums):
            out[w] = upto[last, k]
        return out

    return parts.groupBy("block").applyInPandas(fold, schema)


def _mate(rows: DataFrame, weights: list[str], turn: int) -> DataFrame:
    """Level table of a round of coins: an element that draws 0 folds its successor if that draws 1."""
    coin = lambda c: F.xxhash64(F.lit(turn), c) % 2 == 0
    sums = [f"w_{w}" for w in weights]
    first = rows.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "next", *sums)])
    second = rows.where(~coin(F.col("id"))).select(*[F.col(c).alias(f"b_{c}") for c in ("id", "next", *sums)])
    both = materialize(first.join(second, coin(F.col("a_id")) & (F.col("a_next") == F.col("b_id")), "left"), "mates")
    gone = both.where("b_id is not null").select(
        F.col("b_id").alias("id"), F.col("a_id").alias("head"), *[F.col(f"a_{c}").alias(f"before_{w}") for c, w in zip(sums, weights)],
        F.col("b_next").alias("next"), *[F.col(f"b_{c}").alias(c) for c in sums])
    kept = both.join(gone.select(F.col("id").alias("a_id")), "a_id", "left_anti").select(
        F.col("a_id").alias("id"), F.col("a_id").alias("head"), *[F.lit(0).cast("bigint").alias(f"before_{w}") for w in weights],
        F.when(F.col("b_id").isNotNull(), F.col("b_next")).otherwise(F.col("a_next")).alias("next"),
        *[(F.col(f"a_{c}") + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in sums])
    return kept.unionByName(gone)


def rank_list(rows: DataFrame, weights: list[str], block: int = BLOCK) -> DataFrame:
    """``id`` and, for each weight, ``before_<weight>``: the sum of the weights of all elements before it in the list.

    ``rows``: id (unique), next (id of the next element, -1 at the end) and
    the weights, all long and not null, ids not negative.  Give a weight of
    ones for positions.  Ids that mostly rise along the list make few rounds.
    The rows must form one list; none at all give none.
    """
    now = rows.select("id", "next", *[F.col(w).cast("bigint").alias(f"w_{w}") for w in weights])
    levels: list[DataFrame] = []
    count = rows.count()
    turn = 0
    while count:
        numbered = number_rows(now, [], ["id"], "at").withColumn("block", F.expr(f"at div {block}"))
        levels.append(materialize(_contract(numbered, weights), "level"))
        heads = levels[-1].where("id = head").drop("head", *[f"before_{w}" for w in weights])
        left = heads.count()
        if left > 1 and left > count * 3 // 4:
            turn += 1
            levels.append(materialize(_mate(heads, weights, turn), "level"))
            heads = levels[-1].where("id = head").drop("head", *[f"before_{w}" for w in weights])
            left = heads.count()
        now, count = heads, left
        if left == 1:
            break
    before = [f"before_{w}" for w in weights]
    ranked = None
    for level in reversed(levels):
        own = level.select("id", "head", *before)
        if ranked is None:
            ranked = own.drop("head")
        else:
            up = ranked.select(F.col("id").alias("head"), *[F.col(c).alias(f"up_{c}") for c in before])
            ranked = own.join(up, "head").select("id", *[(F.col(c) + F.col(f"up_{c}")).alias(c) for c in before])
    return rows.select("id", *[F.lit(0).cast("bigint").alias(c) for c in before]) if ranked is None else ranked
