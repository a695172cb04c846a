import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import empty, lower, odd, odd_rows, SF001, table, WORD
from pyspark.sql import functions as F

from feedspark.llm import lm
from feedspark.llm.common import id_fold


def tokens(text):
    return WORD.findall(lower(text or "")) + ["</s>"]


def brute(rows, order, prior=lm.PRIOR, share=lm.SHARE):
    """Scores by walking the automaton token by token over dictionaries of counts."""
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    grams, state = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            seq = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    grams[tuple(seq[i - n + 1:i + 1])] += 1
                    state[tuple(seq[i - n + 1:i])] += 1
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1}
    big, v = sum(uni.values()), len(uni)
    out = []
    for (d, t), h in zip(rows, held):
        seq, base, score, known = ["<s>"] * (order - 1) + tokens(t), 0.0, 0.0, 0
        for i in range(order - 1, len(seq)):
            c = uni.get(seq[i], 0)
            known += c > 0
            p = (c + 0.5) / (big + 0.5 * (v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                ctx = tuple(seq[i - n + 1:i])
                if state[ctx]:
                    k = prior + share * state[ctx]
                    p = (grams[(*ctx, seq[i])] + k * p) / (state[ctx] + k)
            score += math.log10(p)
        out.append((d, h, len(seq) - order + 1, known, big, base, score))
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_odd_rows(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH_TOKENS", 50)
    got = lm.score_documents(odd(spark), id_fold("doc_id") == 1, order=order, group_bytes=4000).collect()
    compare(got, brute([r[:2] for r in odd_rows()], order))


@pytest.mark.parametrize("order", [2, 3])
def test_whole_table_over_groups_and_ranges(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_GRAMS", 5000)
    docs = table(spark, SF001)
    got = lm.score_documents(docs, id_fold("doc_id") == 1, order=order, group_bytes=50_000).collect()
    compare(got, brute([(r.doc_id, r.text) for r in docs.collect()], order))


def test_held_out_text_is_likelier_than_under_the_base(spark):
    got = lm.score_documents(table(spark, SF001), id_fold("doc_id") == 1).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_nothing_to_learn_from_and_empty(spark):
    got = lm.score_documents(odd(spark), F.lit(True)).collect()
    assert len(got) == len(odd_rows()) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert lm.score_documents(empty(spark), F.lit(False)).count() == 0


def net_of(texts, order):
    """The automaton of training texts, as one document group builds it, and the word hashes it was built from."""
    words = lm.Words()
    read = [words.hashes(t.encode()) for t in texts]
    lengths = np.array([len(r) for r in read])
    first = np.cumsum(lengths) - lengths
    grams, size, fail, source, ends, begun = lm.automaton_of(
        lm.grams_of(np.concatenate(read), first, order), first, [lm._begin(n) for n in range(1, order)])
    counts = np.bincount(ends.ravel(), minlength=len(grams)).astype(float)
    counts[begun] = len(texts)
    known, learnt = len(np.unique(ends[0])), int(lengths.sum())
    return lm.Automaton(grams, counts, size, fail, source, known, learnt, order), words


@pytest.mark.parametrize("order", [1, 2, 3])
def test_state_weights_sum_to_one(order):
    net, words = net_of(["a b a c", "a b b", "c a b a"], order)
    assert words.hashes(b"A\tb")[:2].tolist() == words.hashes(b"a B")[:2].tolist()
    vocab = np.append(words.hashes(b"a b c")[:-1], lm.END)
    states = {-1, int(net.place(lm._begin(order - 1))[0])} if order > 1 else {-1}
    for t in ("a b a c", "a b b", "c a b a"):                # all states in front of a token; none is left after the end
        s = np.array([max(states)])
        for w in words.hashes(t.encode())[:-1]:
            s = net.step(s, np.array([w]))[1]
            states.add(int(s[0]))
    assert order == 1 or len(states) > 4
    unknown = 0.5 / (14 + 0.5 * 5)                           # of the root; its share elsewhere goes along the failure arcs
    for s in states:
        p, _ = net.step(np.full(4, s), vocab)
        left, at = unknown, s
        while at >= 0:
            left, at = left * 10 ** net.backoff[at], net.fail[at]
        assert abs((10 ** p).sum() + left - 1) < 1e-12


@pytest.mark.parametrize("order", [2, 3, 4])
def test_stretches_carry_the_same_state(order, monkeypatch):
    rnd = np.random.default_rng(order)
    texts = [" ".join(rnd.choice(list("abcd"), n)) for n in (0, 1, 2, 3, 7, 200, 61)]
    net, words = net_of(texts, order)
    read = [words.hashes(t.encode()) for t in texts]
    lengths, tokens = np.array([len(r) for r in read]), np.concatenate(read)
    start = int(net.place(lm._begin(order - 1))[0])
    want = []
    for r in read:                                           # one text, one token after the other
        state = np.array([start])
        for w in r:
            p, state = net.step(state, np.array([w]))
            want.append(p[0])
    for stretch in (order, 5, 64, 512):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        assert np.allclose(net.read(tokens, lengths, start, order), want, rtol=1e-12, atol=0)
