from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF001

import __spark_entry__ as E
import corpus_pipeline
from feedspark.llm import mixing, secret_scan, simhash
from feedspark.llm.oracles import LLM_ORACLES
from feedspark.llm.queries import llm_queries


def test_all_are_registered():
    assert set(llm_queries()) <= set(E.queries()) and set(LLM_ORACLES) <= set(E.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries() if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(LLM_ORACLES[name])
    cols = [c[0] for c in want.description]
    got = llm_queries()[name](spark, SF001)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


def ids_by_document(rows):
    """How often each id lies in the pieces of each document."""
    out = defaultdict(Counter)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        out[r.doc_id].update(ids.tolist())
    return out


@pytest.fixture(scope="module")
def staged(spark):
    """Rows in front of and behind each stage, called one by one."""
    before = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, seen = before.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF001).cache()
        seen[name] = (before.collect(), after.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    return seen


def test_quality_stage_keeps_what_the_rules_keep(staged):
    (a, b) = staged["quality rules"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({LLM_ORACLES['op9_quality']}) WHERE kept").fetchall()}
    assert 0 < len(kept) < len(a)
    assert sorted(map(tuple, b), key=str) == sorted((tuple(r) for r in a if r.doc_id in kept), key=str)


def test_packing_stage_holds_every_id_once(staged):
    from tokenizers import Tokenizer

    from feedspark.llm.queries import vocabulary

    (a, b) = staged["packing"]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = defaultdict(Counter)
    for r in a:
        want[r.doc_id].update([*tok.encode(r.text, add_special_tokens=False).ids, 1])
    assert ids_by_document(b) == want
    sequences = defaultdict(list)
    for r in b:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048


def test_pipeline_stage_by_stage(spark, staged):
    seen = staged
    (a, b) = seen["simhash near-dedup"]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(a)).collect()}
    assert sorted(r.doc_id for r in b) == sorted(set(groups.values()))
    (a, b) = seen["secret scans"]
    assert {r.doc_id: secret_scan.redact(r.text, secret_scan.scan(r.text)[1]) for r in a} == {r.doc_id: r.text for r in b}
    (a, b) = seen["mixing sources to target weights"]
    assert {r.doc_id for r in b} <= {r.doc_id for r in a} and len(b) > 0
    taken = mixing.mix(mixing.document_sizes(spark.createDataFrame(a)), block_words=1024).per_document().agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.encode().split()) for r in b) == taken


def test_run_equals_the_stages(spark, staged):
    out = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "start", "length", "ids", "sequence_id"} <= set(out.columns)
    rows = out.collect()
    assert rows and ids_by_document(rows) == ids_by_document(staged["packing"][1])


def test_stages_take_empty_and_odd_tables(spark):
    from helpers import empty, odd

    from pyspark.sql import functions as F

    clashing = odd(spark).withColumns({c: F.lit("own") for c in ("_row", "row", "doc", "piece", "pieces", "_pieces", "at", "fp", "component_id", "ids")})
    for docs in (empty(spark), odd(spark, clash=False), clashing):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF001)
            if stage is not corpus_pipeline.pack_sequences:
                assert now.columns == docs.columns
        now.count()
