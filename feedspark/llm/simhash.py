"""SimHash near-duplicates by a binary trie self-join.

1. Every text gets a 64-bit fingerprint from its word shingles (map only).
2. Equal fingerprints fold into one (partial aggregation before the shuffle).
3. The fingerprints, as 64-bit paths, form a binary trie.  Node pairs are
   walked together, differing bits add up, and a pair is pruned when they
   exceed the error budget.  The walk runs twice: a pair with at most k
   differing bits has either at most k // 2 of them among the first 32 bits,
   or fewer than the rest among the last 32.  So the first walk allows k // 2
   errors in the upper half of the path; the second starts from the other half
   and allows k - k // 2 - 1 there.  Both allow k in the whole path, and
   together they miss nothing.
4. The upper levels of the trie (16 at most) are walked on a histogram of
   65,536 counters at most; each surviving pair of leaves is one task group
   ("cell") that walks the lower levels over the fingerprints themselves.  A
   cell returns a spanning forest of its links, never all pairs.
5. Components come from alternating large-star / small-star rounds, written to
   the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import materialize

BITS, HALF, TOP = 64, 32, 16
LEAF = 1 << 12                             # fingerprints that a leaf of the upper trie holds, where 16 bits can tell them apart
FRONTIER = 1 << 20                         # node pairs walked at once inside a cell
BLOCK = 1 << 16                            # shingles hashed at once
_CELL = "fp bigint, walk int, cell bigint, right boolean"


# ---- fingerprints ---------------------------------------------------------------
def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint: bit i is set if it is set in more than half the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    line, start, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(start)
        ends.append(start := start + len(w))
        start += 1
    last = max(1, len(words) - width + 1)
    ends = ends[width - 1:] if len(words) >= width else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, last, BLOCK):
        ones += _ones([digest(line[s:e], 42) for s, e in zip(starts[at:min(at + BLOCK, last)], ends[at:at + BLOCK])])
    return int.from_bytes(np.packbits(ones * 2 > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint's 64 bits as a signed long."""
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text).cast("string")))


# ---- the trie ---------------------------------------------------------------------
def half_budgets(k: int) -> tuple[int, int]:
    """Errors allowed in the first 32 bits of the path, in the first and the second walk."""
    return k // 2, k - k // 2 - 1


def rotate(fp: np.ndarray, walk: int) -> np.ndarray:
    """The path of each fingerprint in a walk, as unsigned numbers: the second walk swaps the halves."""
    path = fp.view(np.uint64)
    return path if walk == 0 else (path << np.uint64(HALF)) | (path >> np.uint64(HALF))


class TopTrie:
    """The upper trie over counts of the leading bits: leaves, and the pairs of leaves within the budget."""

    def __init__(self, counts: np.ndarray, budget: int, leaf: int = LEAF):
        total = np.concatenate([[0], np.cumsum(counts)])
        span = len(counts)                 # counters below a node: 2^16 at the root, 1 at depth 16
        kids, start, width = [], [], []    # per node: (child 0, child 1) or None
        todo = [(0, span)]
        while todo:                        # breadth first: children follow their parent's level
            nxt = []
            for at, w in todo:
                start.append(at)
                width.append(w)
                n = total[at + w] - total[at]
                kids.append(None)
                if n > leaf and w > 1:
                    nxt += [(at, w // 2), (at + w // 2, w // 2)]
                    kids[-1] = True
            todo = nxt
        child = np.full((len(kids), 2), -1, np.int64)
        free = 1
        for i, split in enumerate(kids):
            if split:
                child[i] = free, free + 1
                free += 2
        start, width = np.array(start), np.array(width)
        filled = total[start + width] > total[start]
        is_leaf = child[:, 0] < 0
        leaves = np.flatnonzero(is_leaf)
        leaves = leaves[np.argsort(start[leaves])]
        name = np.full(len(kids), -1, np.int64)
        name[leaves] = np.arange(len(leaves))
        self.starts = start[leaves]        # first counter of each leaf, ascending
        self.pairs = self._walk(child, is_leaf, filled, width, name, budget)

    def partners(self) -> tuple[np.ndarray, ...]:
        """(starts, begin, cell, right): leaf l takes part in ``cell[begin[l]:begin[l + 1]]``, on the side ``right``."""
        i, j = self.pairs.T
        apart = i != j
        leaf = np.concatenate([i, j[apart]])
        cell = np.concatenate([i * len(self.starts) + j, (i * len(self.starts) + j)[apart]])
        right = np.repeat([False, True], [len(i), int(apart.sum())])
        order = np.argsort(leaf, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(self.starts)))])
        return self.starts, begin, cell[order], right[order]

    @staticmethod
    def _walk(child, is_leaf, filled, width, name, budget) -> np.ndarray:
        a = b = np.zeros(1, np.int64)
        diff, found = np.zeros(1, np.int64), []
        while len(a):
            done = is_leaf[a] & is_leaf[b]
            found.append(np.stack([name[a[done]], name[b[done]]], 1))
            a, b, diff = a[~done], b[~done], diff[~done]
            even = (width[a] == width[b]) & ~is_leaf[a] & ~is_leaf[b]
            parts = []
            for i in (0, 1):
                for j in (0, 1):           # both nodes go down a level: differing bits count
                    own = even if i <= j else even & (a != b)
                    parts.append((child[a[own], i], child[b[own], j], diff[own] + (i != j)))
                left = ~even & ~is_leaf[a] & ((width[a] >= width[b]) | is_leaf[b])
                right = ~even & ~left
                parts.append((child[a[left], i], b[left], diff[left]))
                parts.append((a[right], child[b[right], i], diff[right]))
            a, b, diff = (np.concatenate(x) for x in zip(*parts))
            keep = (diff <= budget) & filled[a] & filled[b]
            a, b, diff = a[keep], b[keep], diff[keep]
        pairs = np.concatenate(found)
        return np.unique(np.sort(pairs, axis=1), axis=0)


def _to_cells(batches: Iterator[pd.DataFrame], plan, walk: int) -> Iterator[pd.DataFrame]:
    """Every fingerprint once for each cell that its leaf takes part in."""
    starts, begin, cell, right = plan.value
    for pdf in batches:
        for at in range(0, len(pdf), 1 << 14):
            part = pdf.iloc[at:at + (1 << 14)]
            leaf = np.searchsorted(starts, part["top"].to_numpy(), side="right") - 1
            n = begin[leaf + 1] - begin[leaf]
            row = np.repeat(np.arange(len(part)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[leaf][row]
            yield pd.DataFrame({"fp": part["fp"].to_numpy()[row], "walk": np.int32(walk), "cell": cell[k], "right": right[k]})


def _expand(a, b, c, d) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges a..b and c..d, row by row."""
    na, nb = b - a, d - c
    n = na * nb
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return a[row] + k // nb[row], c[row] + k % nb[row]


def walk_pairs(left: np.ndarray, right: np.ndarray, budget: int, half: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of paths with at most ``budget`` differing bits.

    Node pairs are pairs of index ranges that share their leading bits.  They
    go down one bit at a time; ``half`` bounds the errors of the first 32 bits.
    Small pairs are compared outright.  ``same``: both arrays are one, and each
    unordered pair comes once.  The frontier is cut into pieces of bounded
    size, so memory does not follow the number of pairs.
    """
    def zeros(values):                     # per bit: zeros before each index, made when the walk first gets there
        made: dict[int, np.ndarray] = {}

        def at(bit):
            if bit not in made:
                is0 = (values >> np.uint64(BITS - 1 - bit)) & np.uint64(1) == 0
                made[bit] = np.concatenate([[0], np.cumsum(is0)])
            return made[bit]

        return at

    zl, zr = zeros(left), zeros(right)
    one = lambda x: np.array([x], np.int64)
    todo = [(0, one(0), one(len(left)), one(0), one(len(right)), one(0))]
    while todo:
        bit, a, b, c, d, diff = todo.pop()
        if len(a) > FRONTIER:
            todo += [(bit, *(x[i:i + FRONTIER] for x in (a, b, c, d, diff))) for i in range(0, len(a), FRONTIER)]
            continue
        small = (b - a) * (d - c) <= 16 if bit < BITS else np.ones(len(a), bool)
        if small.any():
            for at in range(0, int(small.sum()), FRONTIER // 16) if bit < BITS else [0]:
                pick = np.flatnonzero(small)[at:at + FRONTIER // 16] if bit < BITS else np.flatnonzero(small)
                i, j = _expand(a[pick], b[pick], c[pick], d[pick])
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                near &= i < j if same else True
                if near.any():
                    yield i[near], j[near]
            a, b, c, d, diff = (x[~small] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        za, zc = zl(bit), zr(bit)
        am, cm = a + za[b] - za[a], c + zc[d] - zc[c]
        most = half if bit < HALF else budget
        parts = []
        own = (a == c) & (b == d) if same else np.zeros(len(a), bool)
        for (x0, x1), (y0, y1), err in (((a, am), (c, cm), 0), ((am, b), (cm, d), 0), ((a, am), (cm, d), 1), ((am, b), (c, cm), 1)):
            go = (x1 > x0) & (y1 > y0) & (diff + err <= most)
            if x0 is am and y0 is c:       # the mirror image of the pair before
                go &= ~own
            parts.append((x0[go], x1[go], y0[go], y1[go], diff[go] + err))
        nxt = tuple(np.concatenate(x) for x in zip(*parts))
        if len(nxt[0]):
            todo.append((bit + 1, *nxt))


class Forest:
    """Union-find over array indices; links come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.root[i], self.root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(self.root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _cell_links(fps: np.ndarray, right: np.ndarray, walk: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside one cell, as two arrays of fingerprints."""
    half = half_budgets(k)[walk]
    in_left = np.unique(rotate(fps[~right], walk))
    same = not right.any()
    in_right = in_left if same else np.unique(rotate(fps[right], walk))
    paths = in_left if same else np.concatenate([in_left, in_right])
    forest, shift = Forest(len(paths)), 0 if same else len(in_left)
    for i, j in walk_pairs(in_left, in_right, k, half, same):
        forest.link(i, j + shift)
    low = np.flatnonzero(forest.root != np.arange(len(paths)))
    back = lambda x: rotate(np.ascontiguousarray(x).view(np.int64), walk).view(np.int64)  # noqa: E731  its own inverse
    return back(paths[low]), back(paths[forest.root[low]])


def links(distinct: DataFrame, k: int = 4, leaf: int = LEAF) -> DataFrame:
    """Links (u, v) between fingerprints at most ``k`` bits apart: for every cell of the trie a spanning forest.

    ``distinct`` has one row per fingerprint (``fp``).  Every pair within ``k``
    bits is connected by the links; not every pair is a link.
    """
    spark = distinct.sparkSession
    cells = None
    for walk, half in enumerate(half_budgets(k)):
        if half < 0:
            continue
        path = F.col("fp") if walk == 0 else F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
        top = F.shiftrightunsigned(path, BITS - TOP).cast("int")
        counts = np.zeros(1 << TOP, np.int64)
        for r in distinct.groupBy(top.alias("top")).count().collect():   # 65,536 rows at most
            counts[r["top"]] = r["count"]
        # at most 65,536 leaves with 137 partners each, in the first walk: 45 MB, whatever the corpus
        plan = spark.sparkContext.broadcast(TopTrie(counts, half, leaf).partners())
        x = distinct.select("fp", top.alias("top")).mapInPandas(partial(_to_cells, plan=plan, walk=walk), _CELL)
        cells = x if cells is None else cells.unionByName(x)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = _cell_links(pdf["fp"].to_numpy(np.int64), pdf["right"].to_numpy(bool), int(pdf["walk"].iat[0]), k)
        return pd.DataFrame({"u": u, "v": v})

    return cells.groupBy("walk", "cell").applyInPandas(cell, "u bigint, v bigint")


# ---- components ---------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it can reach.

    Large-star and small-star rounds until nothing changes.  Each round is
    written to the shared folder.  Rounds grow with the logarithm of the
    longest path, and no step holds a component or a node's links in one group:
    minima are partial aggregates, and the joins behind them split hot nodes.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        sym = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        x = sym.join(low, "u")
        if both:                            # larger neighbours hang on the smallest one
            return x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        rest = x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionAll(low.select("u", F.col("m").alias("v"))).distinct()

    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = materialize(now, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        now = materialize(star(star(now, True), False), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Fingerprints link at ``k`` or fewer differing bits; component_id is the
    smallest doc_id of all rows reachable over links (null if all of these are
    null).  Null and empty texts have fingerprint 0 and link like any other;
    repeated rows come back as often as they came; an empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    marked = fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp")
    marked = materialize(marked, "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fp")
    comp = components(links(distinct, k, leaf))
    rooted = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")
