import random

import pytest
from pyspark.sql import functions as F

from feedspark.operators.scan import scan


def brute(rows):
    """(group, order, id, value) rows: what scan should give by id."""
    out = {}
    by = {}
    for g, o, i, v in rows:
        by.setdefault(g, []).append((o, i, v))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
        last = None
        for k, (_, i, v) in enumerate(own):
            last = v if v is not None else last
            out[i] = (last, own[k + 1][1] if k + 1 < len(own) else None)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16, None])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions or 0)
    rows, n = [], 0
    for g, size, keys in (("hot", 400, 4), ("b", 30, 9), (None, 50, 5), ("lone", 1, 1), ("none", 60, 0)):
        for _ in range(size):
            rows.append((g, rng.choice([None, rng.randrange(500)]), n, n if rng.random() < keys / 100 else None))
            n += 1
    df = spark.createDataFrame(rows, "g string, o long, i long, v long").repartition(5)
    out = scan(df, ["g"], ["o", "i"], F.col("v"), F.col("i"), partitions)
    assert out.columns == [*df.columns, "carried", "following"]
    assert {r.i: (r.carried, r.following) for r in out.collect()} == brute(rows)


def test_struct_values_without_groups_and_single_sides(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 40 == 7, F.struct("id")))
    out = scan(df, [], ["id"], carry=F.col("v"), partitions=9).collect()
    assert {r.id: r.carried and r.carried.id for r in out} == {i: None if i < 7 else i - (i - 7) % 40 for i in range(100)}
    out = scan(df, [], ["id"], follow=F.struct("id"), partitions=9).collect()
    assert {r.id: r.following and r.following.id for r in out} == {i: i + 1 if i < 99 else None for i in range(100)}


def test_empty(spark):
    assert scan(spark.range(0).withColumn("g", F.lit("x")), ["g"], ["id"], F.col("id"), F.col("id")).count() == 0
