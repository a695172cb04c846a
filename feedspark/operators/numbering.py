"""Dense positions in one pass over the rows, without a window over a whole group."""

from __future__ import annotations

from itertools import accumulate
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark.session import materialize


def number_rows(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    out: str = "pos",
    weight_col: str | None = None,
) -> DataFrame:
    """Add ``out``: 0-based position of each row in its group, ordered by ``order_cols``, in one pass over the rows.

    Rows are range-partitioned by (group, order) and written once to the shared
    scratch folder, so every task holds a contiguous run of positions whatever
    the values look like (dense, sparse, one hot group).  Only one small row per
    (task, group) is then counted to find where each run starts.  Rows equal in
    every order column get distinct positions; a tie column spreads them over
    tasks.  Groups may be null.  With ``weight_col`` a row takes that many
    positions and gets the first one (nulls count 0); decimal weights give
    decimal(38,0) positions.
    """
    spark = df.sparkSession
    exact = "decimal(38,0)" if weight_col and dict(df.dtypes)[weight_col].startswith("decimal") else "bigint"
    group_cols, order_cols = list(group_cols), list(order_cols)
    tie = F.xxhash64(F.monotonically_increasing_id())
    rows = df.withColumn("_n_tie", tie)
    keys = [*group_cols, *order_cols, "_n_tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_n_tie")
    runs = materialize(runs.withColumn("_n_at", F.monotonically_increasing_id()), "numbered", spark)
    runs = runs.withColumn("_n_run", F.shiftright("_n_at", 33))
    size = F.sum(F.coalesce(F.col(weight_col), F.lit(0))) if weight_col else F.count(F.lit(1))
    starts = runs.groupBy("_n_run", *group_cols).agg(F.min("_n_at").alias("_n_first"), size.cast(exact).alias("_n_size"))
    if group_cols:
        before = Window.partitionBy(*group_cols).orderBy("_n_run").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.withColumn("_n_from", F.coalesce(F.sum("_n_size").over(before), F.lit(0)))
    else:  # one row per task of the shuffle above, so at most ``n`` rows
        sizes = sorted((r["_n_run"], r["_n_first"], r["_n_size"]) for r in starts.collect())
        froms = accumulate((s for _, _, s in sizes), initial=0)
        starts = spark.createDataFrame(
            [(*r, at) for r, at in zip(sizes, froms)], f"_n_run bigint, _n_first bigint, _n_size {exact}, _n_from {exact}")
    starts = starts.select(*[F.col(c).alias(f"_n_g{i}") for i, c in enumerate(group_cols)],
                           F.col("_n_run").alias("_n_r"), "_n_first", "_n_from")
    same = F.col("_n_run") == F.col("_n_r")
    for i, c in enumerate(group_cols):
        same &= F.col(c).eqNullSafe(F.col(f"_n_g{i}"))
    placed = runs.join(starts, same)
    if weight_col:
        earlier = Window.partitionBy("_n_run", *group_cols).orderBy("_n_at").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(F.coalesce(F.col(weight_col), F.lit(0))).over(earlier), F.lit(0))
    else:
        within = F.col("_n_at") - F.col("_n_first")
    return placed.withColumn(out, (F.col("_n_from") + within).cast(exact)).drop(
        "_n_at", "_n_run", "_n_r", "_n_first", "_n_from", *[f"_n_g{i}" for i in range(len(group_cols))])
