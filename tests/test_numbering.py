import duckdb
from pyspark.sql import functions as F

from feedspark.operators.numbering import number_rows


def _rows(spark):
    hot = [("hot", i * 1_000_003, i % 3) for i in range(4000)]
    few = [(None, 7, 2)] * 5 + [("x", None, 1), ("x", -5, None), ("x", -5, 4)]
    return spark.createDataFrame(hot + few, "g string, k bigint, w bigint").repartition(7)


def test_positions_per_group_sparse_ties_nulls(spark):
    df = _rows(spark)
    got = number_rows(df, ["g"], ["k"], out="p").toPandas()
    assert len(got) == 4008
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.p) == list(range(len(part)))
        known = part.dropna(subset=["k"]).sort_values("p")
        assert known.k.is_monotonic_increasing


def test_weighted_positions_equal_running_sum(spark):
    df = _rows(spark).withColumn("k", F.xxhash64("k"))
    got = number_rows(df, [], ["g", "k"], out="p", weight_col="w").toPandas()
    got = got.fillna({"w": 0}).sort_values(["p", "w"])
    w = got.w
    assert (got.p.to_numpy()[1:] == w.cumsum().to_numpy()[:-1]).all() and got.p.iloc[0] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, k bigint")
    assert number_rows(df, ["g"], ["k"]).count() == 0
    assert number_rows(df, [], ["k"]).count() == 0


def test_plan_reads_the_rows_once(spark):
    plan = number_rows(_rows(spark), [], ["g", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("FileScan") == 1


def test_matches_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").alias("k"))
    pdf = df.toPandas()  # noqa: F841 - read by duckdb
    want = duckdb.sql("select g, k, row_number() over (partition by g order by k) - 1 as p from pdf").fetchall()
    got = [tuple(r) for r in number_rows(df, ["g"], ["k"], out="p").select("g", "k", "p").collect()]
    assert sorted(got) == sorted(want)
