"""Interval join by dyadic blocks: rows whose number lies in one of many ranges, whatever the ranges' lengths.

A range is cut into aligned blocks of 2^level numbers, two per level at most.
A number lies in a range exactly if one of its ancestors (number >> level) is
one of the range's blocks, so the join is an equi-join on (keys, level,
block).  A row is offered on the levels in use only, of which there are 64 at
most and, without huge ranges, about log2 of the longest one.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.operators.scan import scan


def range_blocks(ranges: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``keys, level, block``: the dyadic blocks that make up lo..hi (inclusive; any bigints; none if hi < lo).

    At every level the range that is left goes from the first block that
    starts in it to the last one that ends in it; an odd first and an even last
    one have no sibling in the range, so they are blocks of their own.
    """
    lows = "shiftright(lo, k) + IF(shiftleft(shiftright(lo, k), k) = lo, 0, 1)"
    highs = "shiftright(hi, k) - IF(shiftleft(shiftright(~hi, k), k) = ~hi, 0, 1)"
    cut = F.expr(f"""filter(flatten(transform(transform(sequence(0, 63), k -> struct(k AS level, {lows} AS a, {highs} AS b)), x -> array(
        struct(x.level AS level, IF(x.a <= x.b AND x.a % 2 <> 0, x.a, NULL) AS block),
        struct(x.level AS level, IF(x.a <= x.b AND x.b % 2 = 0, x.b, NULL) AS block)))), p -> p.block IS NOT NULL)""")
    r = ranges.select(*keys, F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi")).where("lo <= hi")
    return r.withColumn("p", F.explode(cut)).select(*keys, "p.level", "p.block")


def in_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The ``rows`` whose ``seq`` lies in one of the ranges (lo..hi per keys; disjoint) of their keys.

    Rows with a null key or number lie in none; repeated rows stay.  Nothing
    grows with the length of a range, and the blocks are hashed one by one, so
    neither a hot key nor a huge range makes a hot task.  Spark broadcasts the
    blocks if their measured size allows, so that ``rows`` need not move.
    """
    blocks = range_blocks(ranges, keys)
    levels = sorted(r["level"] for r in blocks.select("level").distinct().collect())     # 64 at most
    offered = rows.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    offered = offered.withColumn("_block", F.expr(f"shiftright(`{seq}`, _level)"))
    wanted = blocks.withColumnsRenamed({"level": "_level", "block": "_block"})
    return offered.join(wanted, [*keys, "_level", "_block"], "left_semi").select(*rows.columns)


def minus_ranges(ranges: DataFrame, taken: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``keys, lo, hi``: what of ``ranges`` no range of ``taken`` covers (each disjoint per keys; null ends are none).

    Where a range starts and ends are points on one line; two scans carry along
    it whether a point lies in a range and in a taken one.  A range is cut at
    the ends of the others, so neighbours in the result may touch.
    """
    big = "decimal(20,0)"

    def ends(df: DataFrame, flag: str) -> DataFrame:
        first, behind = F.col(lo).cast(big), (F.col(hi).cast(big) + 1).cast(big)
        both = F.array(F.struct(first.alias("at"), F.lit(1).alias("on")), F.struct(behind.alias("at"), F.lit(0).alias("on")))
        return df.where(F.col(lo) <= F.col(hi)).select(*keys, F.explode(both).alias("_e")).select(*keys, "_e.at", F.col("_e.on").alias(flag))

    points = ends(ranges, "_in").unionByName(ends(taken, "_taken"), allowMissingColumns=True)
    points = points.groupBy(*keys, "at").agg(F.max("_in").alias("_in"), F.max("_taken").alias("_taken"))
    x = scan(points, keys, ["at"], carry=F.col("_in"), follow=F.col("at")).withColumnsRenamed({"carried": "_own", "following": "_until"})
    x = scan(x, keys, ["at"], carry=F.col("_taken"))
    left = x.where((F.col("_own") == 1) & (F.coalesce("carried", F.lit(0)) == 0))
    return left.select(*keys, F.col("at").cast("bigint").alias(lo), (F.col("_until") - 1).cast("bigint").alias(hi))
