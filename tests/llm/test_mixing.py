import numpy as np
import pandas as pd
import pytest
from helpers import empty, odd, odd_rows, SF001, SF01, table, WORD
from pyspark.sql import functions as F

from feedspark.llm import mixing as M


def slow_targets(sizes, weights=(1.0, 2.0, 3.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        free = [s for s in names if s not in full]
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 50, "é": 9, "z": 1000, None: 7}, {"x": 5}, {None: 3, "a": 0}, {"a": 0}, {"": 10, "a": 1, "b": 1, "c": 1000, "d": 2},
    {f"s{i}": (i * 37) % 101 + 1 for i in range(50)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(n):
    seen = set()
    for seed in range(4):
        p = M.permute(np.arange(n), np.full(n, n), np.full(n, seed * 7919 - 3))
        assert sorted(p) == list(range(n))
        seen.add(tuple(p))
    assert n < 5 or len(seen) == 4


def mixed(rows):
    p = rows.toPandas()
    assert (p.taken <= 3 * p["size"]).all() and (p.taken >= 0).all()
    return p


def near(p):
    """Each source within two blocks of its target."""
    for _, g in p.groupby(p.source.fillna("￿")):
        size, target = g.source_size.iloc[0], g.target.iloc[0]
        assert size == g["size"].sum()
        block = min(M.BLOCK_WORDS, max(1, -(-size // M.LEAST_BLOCKS)))
        assert abs(g.taken.sum() - target) <= 3 * block + 1


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_whole_table(spark, sf):
    docs = table(spark, sf)
    p = mixed(M.mix(M.document_sizes(docs)).per_document())
    src = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in docs.collect()}
    assert sorted(p.doc_id) == sorted(src) and all(src[d][1] == n for d, n in zip(p.doc_id, p["size"]))
    p["source"] = [src[d][0] for d in p.doc_id]
    near(p)
    want = slow_targets(p.groupby("source")["size"].sum().to_dict())
    assert all(abs(want[s] - t) < 1e-6 * max(1, t) for s, t in zip(p.source, p.target))


def test_reruns_agree_whatever_the_storage(spark):
    docs = table(spark, SF001)
    first = M.mix(M.document_sizes(docs)).per_document().toPandas().sort_values("doc_id")
    again = M.mix(M.document_sizes(docs.repartition(13, F.rand(5)))).per_document().toPandas().sort_values("doc_id")
    pd.testing.assert_frame_equal(first.reset_index(drop=True), again.reset_index(drop=True))


def test_odd_rows(spark):
    p = mixed(M.mix(M.document_sizes(odd(spark))).per_document())
    assert sorted(map(str, p.doc_id.astype("Int64"))) == sorted("<NA>" if d is None else str(d) for d, *_ in odd_rows())
    assert sorted(p["size"]) == sorted(len(WORD.findall(t or "")) for _, t, *_ in odd_rows())
    assert M.mix(M.document_sizes(empty(spark))).per_document().count() == 0
    assert M.mix_documents(empty(spark)).count() == 0


def test_every_draw_is_placed_once(spark):
    s = spark.createDataFrame([(0, 500), (1, 3), (2, 0), (3, 9000), (4, 1)], "rank long, n_draws long")
    got = M.draws(s, seed=4, shard_slots=128).toPandas()
    for rank, n in ((0, 500), (1, 3), (3, 9000), (4, 1)):
        assert sorted(got[got["rank"] == rank].draw) == list(range(n))
    assert len(got) == 9504
    per = got.groupby("shard").size()
    assert (per.iloc[:-1] == 128).all()
    first = got[got["rank"] == 0].groupby("shard").size().reindex(per.index, fill_value=0)
    p = 500 / 9504
    assert first.std() < 2.5 * (128 * p * (1 - p)) ** 0.5 and first.std() > 0


def test_documents_of_the_mix_are_pieces_of_their_texts(spark):
    docs = table(spark, SF001)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = M.mix_documents(docs, block_words=100)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    counted = M.mix(M.document_sizes(docs), block_words=100).per_document().toPandas()
    assert {d: n for d, n in zip(counted.doc_id, counted.taken) if n} == words
