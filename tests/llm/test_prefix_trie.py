import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedspark.llm import list_ranking, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0], digest(*t[1:])))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(t[1:] for t in [*own.get(base, [])[:h], *turns[h:]])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, cs in members.items():
        below = [x for x in members if x[:len(k)] == k]
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])), sum(x not in kids for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df, **sizes):
    return sorted((tuple(r) for r in prefix_trie.build(df, **sizes).select(*COLUMNS).collect()), key=str)


def sample(seed, convs=90):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-150, 400), convs), 0, 100]:
        turns = rng.choice([1, 2, 3, 5, 8, 12])
        for t in range(turns):
            rows.append((c, rng.choice([None, t, t, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a", "bé", "😀"] * 3 + [f"w{c % 7}"])))
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(200, t, "user", "a") for t in range(300)]                 # one conversation holds much of all rows
    rows += [(c, 0, "user", "the same") for c in range(1000, 1090)]      # and one text is the whole of many
    return rows + rows[:20]


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"chunk": 4, "block": 16})])
def test_against_brute_force(spark, seed, sizes):
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("depth", "x1", "pos", "digest", "size", "node_id", "kind", "carried"):
        df = df.withColumn(c, F.lit("x"))
    assert nodes(df, **sizes) == brute(rows)


def test_arcs_nest(spark):
    out = prefix_trie.build(spark.createDataFrame(sample(3, 20), SCHEMA), chunk=8, block=32).collect()
    at = sorted([(r.enter_at, r) for r in out] + [(r.exit_at, r) for r in out], key=lambda x: x[0])
    assert [x[0] for x in at] == list(range(2 * len(out)))
    stack = []
    for k, r in at:
        if k == r.enter_at:
            assert len(stack) == r.depth and (not stack or stack[-1].conv_id == r.parent_conv_id)
            stack.append(r)
        else:
            assert stack.pop() == r


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(c, 1, "user", "x"), (c, 2, "user", "y")]                    # no conversation 0 to take turns from
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        out = prefix_trie.build(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns[:8] == list(COLUMNS)


@pytest.mark.parametrize("n, block, order", [(1, 8, "random"), (700, 8, "random"), (900, 64, "along"), (900, 64, "against"), (300, 4096, "random")])
def test_list_ranking(spark, n, block, order):
    rng = np.random.default_rng(n)
    ids = np.arange(n) * 7 + 3
    path = {"random": rng.permutation(ids), "along": ids, "against": ids[::-1]}[order]
    weight = rng.integers(0, 1 << 40, n)
    rows = [(int(path[k]), int(path[k + 1]) if k + 1 < n else -1, 1, int(weight[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, next long, one long, w long").repartition(4)
    got = {r.id: (r.before_one, r.before_w) for r in list_ranking.rank_list(df, ["one", "w"], block).collect()}
    assert got == {int(p): (k, int(weight[:k].sum())) for k, p in enumerate(path)}
