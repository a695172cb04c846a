import numpy as np
import pytest
import xxhash
from helpers import empty, lower, odd, odd_rows, SF001, table, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from feedspark.llm import simhash


def slow_fingerprint(text, width=4):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(pairs, k):
    """{row number: smallest id} by comparing every two fingerprints."""
    fps = np.array([f for _, f in pairs], dtype=np.uint64)
    comp = list(range(len(pairs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= k):
            comp[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


def check(df, rows, k=4, leaf=simhash.LEAF):
    got = simhash.near_duplicates(df, 4, k, leaf).collect()
    pairs = [(d, slow_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(pairs, slow_components(pairs, k))), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want


def test_odd_rows(spark):
    check(odd(spark), [r[:2] for r in odd_rows()])


def test_whole_table(spark):
    docs = table(spark, SF001)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


@given(st.text(alphabet=st.sampled_from("aAbZ \t\né\x85\xa0ß漢"), max_size=80), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == slow_fingerprint(text, width)


def test_fingerprint_over_blocks(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(1000))
    want = slow_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == want


def clustered(rng, n):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    low = rng.integers(0, 1 << 20, n, dtype=np.uint64)
    return np.unique(np.concatenate([base, near, low]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 7])
def test_walks_find_every_pair(k, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    fps = clustered(np.random.default_rng(k), 120).view(np.int64)
    u = fps.view(np.uint64)
    want = {(int(min(u[i], u[j])), int(max(u[i], u[j]))) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= k) if i != j}
    got = set()
    for walk, half in enumerate(simhash.half_budgets(k)):
        if half < 0:
            continue
        paths = np.unique(simhash.rotate(fps, walk))
        back = simhash.rotate(paths.view(np.int64), walk)
        for i, j in simhash.walk_pairs(paths, paths, k, half, True):
            found = {(int(min(a, b)), int(max(a, b))) for a, b in zip(back[i], back[j])}
            assert len(found) == len(i)
            got |= found
    assert got == want


@pytest.mark.parametrize("k,leaf", [(4, 8), (4, 50), (3, 1), (1, 20)])
def test_links_over_many_cells(spark, k, leaf):
    fps = clustered(np.random.default_rng(leaf), 150).view(np.int64)
    pairs = [(i, int(f) & (1 << 64) - 1) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    edges = simhash.links(df, k, leaf)
    comp = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components(pairs, k)
    groups = {}
    for (i, _), c in zip(pairs, want):
        groups.setdefault(c, set()).add(int(fps[i]))
    for members in groups.values():
        assert {comp.get(f, f) for f in members} == {min(members)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(7000, 7000)]
    comp = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {comp[i] for i in range(201)} == {0} and {comp[i] for i in range(1000, 1400)} == {1000} and 7000 not in comp
