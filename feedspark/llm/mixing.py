"""Mixing sources to target weights: blocks, multinomial shard counts, permuted indices, one join.

1. Each source's documents, in an order fixed by a hash of their ids, make one
   stream of words, cut into blocks of fixed length.
2. The target of a source, in blocks, is its number of draws.  Every slot of
   every output shard draws its source, so a shard's source counts are
   multinomial.  Where all shards together draw a source too often, the draws
   that a pseudorandom permutation puts past its target go to the sources that
   lack some, one for one: the totals are the targets, exactly.
3. Draw j of a source takes the block perm(j mod n) in epoch j div n, with a
   permutation of 0..n-1 of its own for every (source, epoch): in one epoch no
   block comes twice.
4. One join by (source, block index) brings draws and blocks together.

Sources, shard counts, slots and blocks are all tables; only scalars reach the
driver, and a source may hold any part of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm.common import materialize, text_or_empty, word_count
from feedspark.operators.numbering import number_rows

BLOCK_WORDS, LEAST_BLOCKS = 64, 128        # block length; a small source has shorter blocks, so that it has so many
SHARD_SLOTS = 1024
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3
_WIDTH, _LEVEL = 1024, 1 << 16             # positions per bucket of an interval join, buckets made at once
_U64 = np.uint64


# ---- targets -------------------------------------------------------------------
def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight until no target is above.
    """
    s = number_rows(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], out="rank").drop("_null")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = materialize(s.withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int"))), "sources")
    ceiling = (F.col("source_size") * most).cast("double")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:                            # each turn holds at least one more source at its ceiling
        full = ceiling <= F.col("weight") * level
        held, n, open_weight = s.agg(F.sum(F.when(full, ceiling)), F.count(F.when(full, 1)),
                                     F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not open_weight:
            break
        n_full, level = n, (total - (held or 0.0)) / open_weight
    return s.withColumn("target", F.least(ceiling, F.col("weight") * F.lit(level)))


# ---- permutations ----------------------------------------------------------------
def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """perm(index) for a pseudorandom permutation of 0..n-1 chosen by ``seed``, element by element.

    A four-round Feistel network permutes the smallest range of 4^b >= n
    numbers; results that fall outside 0..n-1 go through it again.
    """
    index, n, seed = index.astype(_U64), n.astype(_U64), seed.astype(np.int64).view(_U64)
    b = np.maximum(np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2), 1).astype(_U64)
    mask = (_U64(1) << b) - _U64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, m, s, w = out[todo], mask[todo], seed[todo], b[todo]
        left, right = x >> w, x & m
        for turn in range(4):
            left, right = right, left ^ (_scramble(right, s + _U64(turn)) & m)
        out[todo] = (left << w) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted(index: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(), n.to_numpy(), seed.to_numpy()))


def _interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, size: str) -> DataFrame:
    """``points`` whose ``at`` lies in [start, start + size), with the interval's columns: an equi-join on position buckets."""
    first, last = F.col(start), F.col(start) + F.col(size) - 1
    cut = intervals.where(F.col(size) > 0).withColumns({"_b0": F.floor(first / _WIDTH), "_b1": F.floor(last / _WIDTH)})
    cut = cut.withColumn("_b0", F.explode(F.sequence("_b0", "_b1", F.lit(_LEVEL))))       # in two levels: no long array
    cut = cut.withColumn("_bucket", F.explode(F.sequence("_b0", F.least(F.col("_b0") + _LEVEL - 1, "_b1")))).drop("_b0", "_b1")
    joined = points.withColumn("_bucket", F.floor(F.col(at) / _WIDTH)).join(cut, "_bucket")
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(size))).drop("_bucket")


# ---- the mix -----------------------------------------------------------------------
def blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Pieces of documents in blocks: rank (of the source), block, row, at (first word in the document), words."""
    s = sources.where("n_blocks > 0").select(F.col("source").alias("_source"), "rank", "block_len")
    x = rows.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("_source")))
    first, last = F.col("first"), F.col("first") + F.col("size") - 1
    x = x.withColumn("block", F.explode(F.sequence(F.expr("first div block_len"), F.expr("(first + size - 1) div block_len"))))
    a = F.greatest(F.col("block") * F.col("block_len"), first)
    b = F.least((F.col("block") + 1) * F.col("block_len") - 1, last)
    return x.select("rank", "block", "row", (a - first).alias("at"), (b - a + 1).alias("words"))


def draws(sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, draw, shard): every draw 0..n_draws-1 of every source once, with the shard that it fell into."""
    spark = sources.sparkSession
    s = sources.where("n_draws > 0").select("rank", "n_draws")
    s = materialize(number_rows(s, [], ["rank"], out="from", weight_col="n_draws"), "draws")
    total = int(s.agg(F.sum("n_draws")).first()[0] or 0)
    slots = spark.range(total).select(
        F.expr(f"id div {shard_slots}").alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("at"))
    drawn = _interval_join(slots, "at", s, "from", "n_draws")
    counts = materialize(drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n")), "shard_counts")
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    s = s.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    s = s.withColumns({"over": F.greatest(F.col("got") - F.col("n_draws"), F.lit(0)),
                       "short": F.greatest(F.col("n_draws") - F.col("got"), F.lit(0))})
    s = number_rows(s, [], ["rank"], out="over_from", weight_col="over")
    s = materialize(number_rows(s, [], ["rank"], out="short_from", weight_col="short"), "quotas")
    runs = number_rows(counts, ["rank"], ["shard"], out="first", weight_col="n")
    each = runs.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    each = each.select("rank", "shard", "j").join(s.select("rank", "n_draws", "got", "over_from"), "rank")
    each = each.withColumn("draw", F.when(F.col("got") > F.col("n_draws"),
                                          permuted("j", "got", F.xxhash64("rank", F.lit(seed + 1)))).otherwise(F.col("j")))
    each = materialize(each, "slots")
    kept = each.where("draw < n_draws").select("rank", "draw", "shard")
    given = each.where("draw >= n_draws").select("shard", (F.col("over_from") + F.col("draw") - F.col("n_draws")).alias("at"))
    given = _interval_join(given, "at", s.select("rank", "got", "short", "short_from"), "short_from", "short")
    return kept.unionByName(given.select("rank", (F.col("got") + F.col("at") - F.col("short_from")).alias("draw"), "shard"))


class Mix:
    """The mix of a table of documents; see ``mix``."""

    def __init__(self, rows: DataFrame, sources: DataFrame, taken: DataFrame):
        self.rows, self.sources, self.taken = rows, sources, taken

    def per_document(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (words, repeats counted) of every row."""
        words = self.taken.groupBy("row").agg(F.sum("words").alias("taken"))
        s = self.sources.select(F.col("source").alias("_source"), "source_size", "target")
        x = self.rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).join(words, "row", "left")
        return x.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix(rows: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS,
        most: int = MOST) -> Mix:
    """Draw blocks of ``rows`` (row, doc_id, source, size) so that the sources meet their targets.

    ``taken`` has a row for every drawn piece: row, at, words, shard, draw.
    The result depends on the ids, sizes and sources alone, not on how the
    table is stored.  Rows without words are never drawn; a null source is one
    more source, behind the others; repeated rows are separate documents; an
    empty table gives empty results.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    s = source_targets(sizes, weights, most)
    size = F.col("source_size")
    s = s.withColumn("block_len", F.least(F.lit(block_words), F.greatest(F.ceil(size / LEAST_BLOCKS), F.lit(1))).cast("bigint"))
    s = s.withColumn("n_blocks", F.ceil(size / F.col("block_len")).cast("bigint"))
    n_draws = F.round(F.col("target") * F.col("n_blocks") / F.greatest(size, F.lit(1))).cast("bigint")
    s = materialize(s.withColumn("n_draws", F.least(n_draws, F.col("n_blocks") * most)), "targets")
    placed = number_rows(rows.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))), ["source"], ["_h", "doc_id", "size"],
                         out="first", weight_col="size")
    pieces = blocks(placed, s)
    n = s.select("rank", "n_blocks")
    drawn = draws(s, seed).join(n, "rank").withColumn(
        "block", permuted(F.expr("draw % n_blocks"), F.col("n_blocks"), F.xxhash64("rank", F.expr("draw div n_blocks"), F.lit(seed))))
    taken = drawn.select("rank", "block", "draw", "shard").join(pieces, ["rank", "block"])
    return Mix(rows, s, taken.select("row", "at", "words", "shard", "draw"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size) of every document, written once; ``row`` names the row within this table."""
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"),
                    word_count(text_or_empty()).alias("size"))
    return materialize(x, "sizes")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(texts: pd.Series, pieces: pd.Series) -> pd.Series:
    import re

    word = re.compile("[^\\x20\\x09-\\x0D]+")
    out = []
    for text, wanted in zip(texts, pieces):
        at = [m.span() for m in word.finditer(text)]
        out.append([text[at[p["at"]][0]:at[p["at"] + p["words"] - 1][1]] for p in wanted])
    return pd.Series(out)


def mix_documents(docs: DataFrame, seed: int = 1, block_words: int = 1024, weights: tuple[float, ...] = WEIGHTS,
                  most: int = MOST) -> DataFrame:
    """The mixed corpus: one row per drawn piece of a document, with the columns of ``docs``.

    ``text`` is the piece, from its first to its last word as written;
    ``n_chars``, if there, is its length; the other columns are the
    document's.  Rows whose text has no word are not drawn.
    """
    whole = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    rows = materialize(whole.select("row", "doc.doc_id", F.col("doc.source").cast("string").alias("source"),
                                    word_count(text_or_empty("doc.text")).alias("size")), "sizes")
    wanted = mix(rows, seed, block_words, weights, most).taken.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "words", "draw"))).alias("pieces"))  # bounded by the document itself
    x = whole.join(wanted, "row").select("doc", F.explode(_cut("doc.text", "pieces")).alias("piece"))
    new = {"text": F.col("piece"), "n_chars": F.length("piece")}
    return x.select(*[(new[c].cast(t) if c in new else F.col("doc")[c]).alias(c) for c, t in docs.dtypes])
