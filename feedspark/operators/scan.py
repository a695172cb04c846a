"""Carrying values along ordered rows, whatever the size of a group.

Rows are range-partitioned by (group, order) and written once, so each task
holds a contiguous run of them.  Values are carried inside a run by a window
over (run, group), and from run to run over one small row per run: the first
and the last group of the run with what enters and leaves it.  No window sees
a whole group, and no value is copied more than once.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.session import materialize


def scan(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    carry: Column | None = None,
    follow: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``carried`` and ``following``, as asked for.

    ``carried`` is the last value of ``carry`` that is not null, at the row or
    before it in its group; ``following`` is the value of ``follow`` at the next
    row of the group.  Order is ascending, nulls first; rows equal in every
    order column follow each other in any order, the same for both.  Groups
    may be null.  ``partitions`` fixes the number of runs (else Spark's
    settings and statistics decide).
    """
    spark = df.sparkSession
    keys = [*group_cols, *order_cols]
    asked = {"_s_c": carry, "_s_f": follow}
    asked = {k: v for k, v in asked.items() if v is not None}
    rows = df.withColumns(asked) if asked else df
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    rows = materialize(rows.sortWithinPartitions(*keys).withColumn("_s_at", F.monotonically_increasing_id()), "runs", spark)
    rows = rows.withColumn("_s_run", F.shiftright("_s_at", 33))
    own = Window.partitionBy("_s_run", *group_cols).orderBy("_s_at")
    if carry is not None:
        before = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_s_in", F.last("_s_c", ignorenulls=True).over(before))
    if follow is not None:
        rows = rows.withColumns({"_s_next": F.lead("_s_f").over(own), "_s_last": F.lead(F.lit(True), 1, False).over(own)})

    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)], F.lit(0).alias("z"))
    ends = {"_s_first_g": F.min_by(group, "_s_at"), "_s_last_g": F.max_by(group, "_s_at")}
    if carry is not None:
        ends["_s_v"] = F.max_by("_s_in", "_s_at")
    if follow is not None:
        ends["_s_w"] = F.min_by("_s_f", "_s_at")
    edges = rows.groupBy("_s_run").agg(*[v.alias(k) for k, v in ends.items()])        # a row per task of the sort
    sides = edges.select(
        F.col("_s_run").alias("_s_r"), "_s_first_g", "_s_last_g",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_s_first_g").alias("g")),
                          F.struct(F.lit(1).alias("side"), F.col("_s_last_g").alias("g")))).alias("_s_e"),
        *[c for c in ("_s_v", "_s_w") if c in edges.columns])
    along = Window.partitionBy("_s_e.g").orderBy("_s_r", "_s_e.side")
    at_start, at_end = F.col("_s_e.side") == 0, F.col("_s_e.side") == 1
    into = {}
    if carry is not None:
        into["_s_enter"] = F.last(F.when(at_end, F.col("_s_v")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    if follow is not None:
        into["_s_after"] = F.lead(F.when(at_start, F.col("_s_w"))).over(along)
    sides = sides.withColumns(into)
    per_run = [F.first(F.when(at_start, F.col("_s_enter")), ignorenulls=True).alias("_s_enter")] if carry is not None else []
    per_run += [F.first(F.when(at_end, F.col("_s_after")), ignorenulls=True).alias("_s_after")] if follow is not None else []
    per_run = sides.groupBy("_s_r").agg(F.first("_s_first_g").alias("_s_first_g"), F.first("_s_last_g").alias("_s_last_g"), *per_run)

    # as many rows as the sort had tasks, so its size is known to be small
    out = rows.join(F.broadcast(per_run), F.col("_s_run") == F.col("_s_r"), "left")
    if carry is not None:
        out = out.withColumn("carried", F.coalesce("_s_in", F.when(group.eqNullSafe(F.col("_s_first_g")), F.col("_s_enter"))))
    if follow is not None:
        out = out.withColumn("following", F.when(F.col("_s_last"), F.col("_s_next"))
                             .when(group.eqNullSafe(F.col("_s_last_g")), F.col("_s_after")))
    return out.drop(*[c for c in out.columns if c.startswith("_s_")])
