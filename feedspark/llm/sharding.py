"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard gives every key a score that depends on the key, the shard's name
and its weight alone; the key goes to the shard with the highest score.  When
a shard is added, the scores of the others stay, so a key either keeps its
shard or moves to the new one; when a shard's weight grows, keys only move
into it.  Everything is a projection: no shuffle, no state.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import materialize, text_or_empty, utf8_bytes
from feedspark.operators.numbering import number_rows

_HEX = 13                                  # hex digits of the digest that make the uniform draw (52 bits)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard (int) of each key under the given shard weights; a null key counts as the empty text.

    score = -weight / ln(u), with u in (0, 1) from md5(key | shard); the
    largest score wins, ties go to the larger shard number.
    """
    if not weights or any(not (w > 0) or math.isinf(w) for w in weights.values()):
        raise ValueError("every shard needs a positive, finite weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = []
    for shard, weight in sorted(weights.items()):
        digest = F.md5(F.concat(text, F.lit(f"|{shard}")))
        draw = (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 4 * _HEX))
        bids.append(F.struct((F.lit(-float(weight)) / F.log(draw)).alias("score"), F.lit(int(shard)).alias("shard")))
    return F.array_max(F.array(*bids))["shard"] if len(bids) > 1 else bids[0]["shard"]


def assign(df: DataFrame, key: str, weights: Mapping[int, float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; a column named ``out`` that is already there is replaced."""
    return df.withColumn(out, shard_of(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: Mapping[int, float], path: str) -> None:
    """The rows as files, one folder per shard; every task writes into all shards, so a shard is never one task."""
    assign(df, key, weights, "shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 by (doc_id, size, text_crc32).
    ``grown_shard`` is the shard under the weights ``grown``.  A null text has
    size 1 and the checksum of the empty text; rows with a null doc_id share
    the shard of the empty key; repeated rows get a slot each; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id"),
        (utf8_bytes(text) + 1).alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    narrow = materialize(narrow, "shards")
    return number_rows(narrow, ["shard"], ["doc_id", "size", "text_crc32"], out="slot")
