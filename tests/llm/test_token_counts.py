import random

import pytest
import sentencepiece
from helpers import empty, odd, odd_rows, SF001, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedspark.llm import token_counts as C
from feedspark.llm.queries import vocabulary

PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_model_can_be_cut():
    assert C.cuttable(PIECES)


@given(st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "<s>", "</s>", "<unk>", "\x00", "　"]), max_size=120).map("".join),
       st.integers(1, 40))
@settings(max_examples=400, deadline=None)
def test_cuts_keep_the_tokens(text, size):
    assert [i for p in C.cut(text, size) for i in SP.encode(p)] == SP.encode(text)


def test_cuts_of_documents_keep_the_tokens(spark):
    for r in table(spark, SF001).collect():
        assert sum(len(SP.encode(p)) for p in C.cut(r.text, 50)) == len(SP.encode(r.text))


def test_batches_cover_in_order_and_by_bytes():
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 50, 400]) for _ in range(500)]
    runs = list(C.batches(sizes, 300))
    assert [i for a, b in runs for i in range(a, b)] == list(range(500))
    assert all(sum(sizes[a:b]) <= 300 or b - a == 1 for a, b in runs)


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts_equal_the_library(spark, path, monkeypatch):
    monkeypatch.setattr(C, "BATCH_BYTES", 5000)
    rows = odd_rows() + [(20, "<|endoftext|> <s> x", "", "", 1)]
    if path == PIECES:
        want = [len(SP.encode(t or "")) for _, t, *_ in rows]
    else:
        tok = Tokenizer.from_file(path)
        want = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    assert C.count_tokens([r[1] or "" for r in rows], path).tolist() == want


def test_odd_rows(spark):
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(odd(spark), PIECES, 10).collect()))
    want = sorted((str(d), len((t or "").encode()), n := len(SP.encode(t or "")), n > 10) for d, t, *_ in odd_rows())
    assert got == want
    assert C.token_counts(empty(spark), PIECES).count() == 0
