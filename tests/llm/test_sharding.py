import zlib
from collections import Counter

import pytest
from helpers import empty, odd, odd_rows
from pyspark.sql import functions as F

from feedspark.llm import sharding

EIGHT = dict.fromkeys(range(8), 1.0)


def test_odd_rows_slots_and_checksums(spark):
    got = sharding.shard_documents(odd(spark), EIGHT, {**EIGHT, 8: 1.0}).collect()
    want = Counter((d, len((t or "").encode()) + 1 if t is not None else 1, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert sharding.shard_documents(empty(spark), EIGHT, EIGHT).count() == 0


def test_weights_and_growth(spark):
    ids = spark.range(60_000).withColumnRenamed("id", "k")
    x = sharding.assign(ids, "k", {0: 1.0, 1: 2.0, 2: 3.0}, "a")
    x = sharding.assign(x, "k", {0: 1.0, 1: 2.0, 2: 3.0, 3: 2.0}, "b").withColumn("c", sharding.shard_of(F.col("k"), {0: 1.0, 1: 4.0, 2: 3.0}))
    n = {r.a: r["count"] for r in x.groupBy("a").count().collect()}
    assert abs(n[0] / 10_000 - 1) < 0.05 and abs(n[1] / 20_000 - 1) < 0.05 and abs(n[2] / 30_000 - 1) < 0.05
    assert {(r.a == r.b) or r.b == 3 for r in x.select("a", "b").distinct().collect()} == {True}
    assert {(r.a == r.c) or r.c == 1 for r in x.select("a", "c").distinct().collect()} == {True}
    assert abs(x.where("b = 3").count() / 15_000 - 1) < 0.05


def test_write_shards(spark, tmp_path):
    sharding.write_shards(odd(spark, clash=False), "doc_id", {0: 1.0, 1: 1.0}, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(odd_rows())


def test_bad_weights():
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), {})
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), {0: 0.0})
