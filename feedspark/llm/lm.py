"""LM scoring: a weighted backoff automaton over smoothed word n-grams.

Counts.  Documents are dealt into groups of about ``GROUP_BYTES`` of text.
Each group counts its own n-grams (64-bit hashes, numpy) and sends them, in
packets by hash range, to the task that owns the range.  That task adds the
training counts of all groups and answers each group with the totals that
differ from the group's own; n-grams that occur in one group only never travel
twice.  So every group ends up with exactly the counts its texts need, however
large the corpus is; nothing is pruned, sampled or broadcast.

Automaton.  A state is a context of up to order-1 words seen in training.  Its
arcs are its seen continuations, weight (c(h w) + K P(w | h')) / (c(h) + K);
its failure arc leads to the shorter context h' with weight K / (c(h) + K),
where K = PRIOR + SHARE * c(h): SHARE bounds what rare luck in a frequent context
can cost a new text, PRIOR what a rare context may claim.  The root has the additive unigram weights, so every state's weights sum to one
over the vocabulary and the unknown word.  Every group builds the tables of the
automaton for its own texts (``Automaton``): arcs with weight and target, failure
arcs with weight and target.  A text is read once, left to right, and the state is
carried: from it, failure arcs are followed until a state has an arc for the
token, the logarithms of all arcs add up, and the token's arc leads to the next state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import part_count, text_or_empty, zipped

ORDER, PRIOR, SHARE = 2, 5.0, 4.0
GROUP_BYTES = 12 << 20                     # text bytes of a document group
RANGE_GRAMS = 2 << 20                      # n-grams that one range owner sums up, about
FLUSH_TOKENS = 1 << 22                     # tokens counted before packets leave
STRETCH = 512                              # tokens of a long text that are read in one go
END, BEGIN = np.uint64(1), np.uint64(2)    # the end token, and the context in front of the first token
_MIX, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_PACKET = "part int, grp int, grams binary, counts binary"
_ANSWER = _PACKET + ", known bigint, tokens bigint"
_SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
           "base_score double, score double")


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of context ``h`` followed by word ``w``."""
    x = (h ^ (h >> np.uint64(29))) * _MIX + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit word hashes with a bounded memory of the words seen last."""

    def __init__(self, most: int = 1 << 19):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def hashes(self, text: bytes) -> np.ndarray:
        """Hashes of the tokens of a text in UTF-8: its words (A-Z lower-cased), then the end."""
        words = text.lower().split()        # of bytes: ASCII case and ASCII white space only
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w) | 4    # never END or BEGIN
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def grams_of(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n-gram that ends at each token (behind a text's start: begin marks).

    ``tokens`` are those of texts one after the other, ``first`` where each
    text begins.  The lowest bit tells single tokens (1) from longer n-grams (0).
    """
    out = [_mix(np.zeros(1, np.uint64), tokens) | _ONE]
    for n in range(2, order + 1):          # a context's hash and the next word make the n-gram's hash
        before = np.roll(out[-1], 1)
        before[first] = _begin(n - 1)
        out.append(_mix(before + np.uint64(n), tokens) & ~_ONE)
    return out


def _begin(n: int) -> np.ndarray:
    """Hash (one element) of the context of ``n`` begin marks."""
    h = _mix(np.zeros(1, np.uint64), np.array([BEGIN]))
    for k in range(2, n + 1):
        h = _mix(h + np.uint64(k), np.array([BEGIN]))
    return h & ~_ONE


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, most significant bytes of all of them together: those of sorted keys and of small counts repeat."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _spread(packed: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _tally(texts: list[np.ndarray], train: list[bool], order: int, n_ranges: int, grp: int) -> pd.DataFrame:
    """Packets of one document group: its distinct n-grams and contexts by range, with their training counts."""
    lengths, train = np.array([len(t) for t in texts]), np.array(train, bool)
    own = grams_of(np.concatenate(texts), np.cumsum(lengths) - lengths, order)
    learnt = np.repeat(train, lengths)
    begins = [np.repeat(_begin(n), int(train.sum())) for n in range(1, order)]
    grams, counts = np.unique(np.concatenate([*(g[learnt] for g in own), *begins]), return_counts=True)
    rest = np.unique(np.concatenate([*(g[~learnt] for g in own), *(_begin(n) for n in range(1, order))]))
    rest = rest[~np.isin(rest, grams, assume_unique=True)]   # asked for, never counted
    order_ = np.argsort(both := np.concatenate([grams, rest]))
    grams, counts = both[order_].astype("<u8"), np.concatenate([counts, np.zeros(len(rest), np.int64)])[order_].astype("<u4")
    edge = np.searchsorted(grams, [np.uint64((r << 64) // n_ranges) for r in range(1, n_ranges)])
    return pd.DataFrame({
        "part": np.arange(n_ranges, dtype=np.int32), "grp": np.int32(grp),
        "grams": [_squeeze(g) for g in np.split(grams, edge)],
        "counts": [_squeeze(c) for c in np.split(counts, edge)]})


def _count(batches: Iterator[pd.DataFrame], order: int, n_ranges: int) -> Iterator[pd.DataFrame]:
    words, held, n = Words(), {}, 0
    unpack = zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        for grp, text, train in zip(pdf["grp"], pdf["text"], pdf["train"]):
            tokens = words.hashes(unpack(text))
            texts, trained = held.setdefault(grp, ([], []))
            texts.append(tokens)
            trained.append(train)
            n += len(tokens)
            if n >= FLUSH_TOKENS:
                yield from (_tally(*h, order, n_ranges, g) for g, h in held.items())
                held, n = {}, 0
    yield from (_tally(*h, order, n_ranges, g) for g, h in held.items())


def _sum_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one hash range, answered to every group where they differ from what the packet has itself.

    ``known`` and ``tokens`` (distinct training tokens of the range, and how
    often they occur) go to each group once.
    """
    grams = [_spread(b, "<u8") for b in pdf["grams"]]
    counts = [_spread(b, "<u4") for b in pdf["counts"]]
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype("<i8")
    single = total[(every & _ONE) == 1]
    known, tokens = int((single > 0).sum()), int(single.sum())
    out, told, a = [], set(), 0
    for grp, own, had in zip(pdf["grp"], grams, counts):
        mine = at[a:a + len(own)]
        a += len(own)
        differs = total[mine] != had
        out.append((pdf["part"].iat[0], grp, _squeeze(own[differs]), _squeeze(total[mine[differs]]),
                    0 if grp in told else known, 0 if grp in told else tokens))
        told.add(grp)
    return pd.DataFrame(out, columns=["part", "grp", "grams", "counts", "known", "tokens"])


class Automaton:
    """The weighted backoff automaton over the n-grams that the texts of one document group use.

    An arc is a training n-gram (or any single token, from the root), known by
    its place in the sorted ``keys``; a state is the n-gram that was read last,
    -1 the root.  Tables by arc: ``weight`` (log10), the state it leads to
    (``goto``); by state: the failure arc's target (``fail``) and weight
    (``backoff``, log10), and its number of words (``size``).
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, size: np.ndarray, fail: np.ndarray, source: np.ndarray,
                 known: int, tokens: int, order: int, prior: float = PRIOR, share: float = SHARE):
        """``fail`` and ``source`` give, by n-gram, the place of the n-gram without its first and without its last word (-1: none)."""
        kept = (counts > 0) | ((grams & _ONE) == 1)
        place = np.append(np.cumsum(kept) - 1, -1)           # the last one: -1 stays -1
        self.keys, c, self.size = grams[kept], counts[kept], size[kept]
        self.fail, source = place[fail[kept]], place[source[kept]]
        k = prior + share * c
        with np.errstate(divide="ignore"):
            self.backoff = np.log10(k / (c + k))
        p = (c + 0.5) / (tokens + 0.5 * (known + 1))
        for n in range(2, order + 1):                        # an arc's weight from that of its shorter n-gram
            at = np.flatnonzero((self.size == n) & (source >= 0))
            h = source[at]
            p[at] = (c[at] + k[h] * p[self.fail[at]]) / (c[h] + k[h])
        self.weight = np.log10(p)
        self.goto = np.where(self.size == order, self.fail, np.where(c > 0, np.arange(len(c)), -1))

    def place(self, h: np.ndarray) -> np.ndarray:
        """Arcs or states of hashes; -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def step(self, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token each: from ``state`` along failure arcs to the first state with an arc for the token; (log10, next state)."""
        state, p, arc = state.copy(), np.zeros(len(state)), np.full(len(state), -1)
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], words[todo]
            longer = _mix(self.keys[s] + (self.size[s] + 1).astype(np.uint64), w) & ~_ONE
            arc[todo] = self.place(np.where(s < 0, _mix(np.zeros(1, np.uint64), w) | _ONE, longer))
            todo = todo[arc[todo] < 0]                       # the root has an arc for every token
            s = state[todo]
            p[todo] += self.backoff[s]
            state[todo] = self.fail[s]
        return p + self.weight[arc], self.goto[arc]

    def read(self, tokens: np.ndarray, lengths: np.ndarray, start: int, order: int) -> np.ndarray:
        """log10 probability of every token, each text read once from left to right, the state carried from token to token.

        Texts are read side by side, one token of each in a step, and long ones
        in stretches of ``STRETCH`` tokens.  A stretch inside a text first reads
        the order-1 tokens in front of it from the root, which leads to the same
        state as reading from the text's start: the longest seen context.
        """
        first, out = np.cumsum(lengths) - lengths, np.empty(len(tokens))
        pieces = -(-lengths // STRETCH)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + nth * STRETCH
        end = np.minimum(begin + STRETCH, np.repeat(first + lengths, pieces))
        warm = np.where(nth > 0, order - 1, 0)
        state = np.where(nth > 0, -1, start)
        by_length = np.argsort(-(end - begin + warm), kind="stable")
        at, warm, state = (begin - warm)[by_length], warm[by_length], state[by_length]
        steps = (end - begin)[by_length] + warm
        for t in range(int(steps[0])):
            n = int(np.searchsorted(-steps, -t, side="left"))          # stretches with more than t tokens
            p, state[:n] = self.step(state[:n], tokens[at[:n] + t])
            counted = warm[:n] <= t
            out[at[:n][counted] + t] = p[counted]
        return out


def automaton_of(by_n: list[np.ndarray], first: np.ndarray, begins: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """``grams`` (sorted hashes), their ``size``, ``fail`` and ``source`` places, and the places of all n-grams and begin contexts.

    ``by_n[n - 1]`` has the n-gram that ends at each token.  Its last n-1 words
    are the (n-1)-gram that ends there, its first n-1 the one that ends a token
    before, or a context of begin marks.
    """
    total, order = len(by_n[0]), len(by_n)
    grams, at = np.unique(np.concatenate([*by_n, *begins]), return_inverse=True)
    size, fail, source = np.zeros(len(grams), np.int64), np.full(len(grams), -1), np.full(len(grams), -1)
    begun = at[order * total:]
    size[begun] = np.arange(1, order)
    fail[begun[1:]] = begun[:-1]
    ends = at[:order * total].reshape(order, total)
    for n in range(1, order + 1):
        size[ends[n - 1]] = n
        if n > 1:
            fail[ends[n - 1]] = ends[n - 2]
            before = np.roll(ends[n - 2], 1)
            before[first] = begun[n - 2]
            source[ends[n - 1]] = before
    return grams, size, fail, source, ends, begun


def _score(docs: pd.DataFrame, answers: pd.DataFrame, order: int, prior: float = PRIOR, share: float = SHARE) -> pd.DataFrame:
    if docs.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _SCORED.split(", ")])
    words, unpack = Words(), zstandard.ZstdDecompressor().decompress
    texts = [words.hashes(unpack(t)) for t in docs["text"]]
    lengths = np.array([len(t) for t in texts])
    first, tokens = np.cumsum(lengths) - lengths, np.concatenate(texts)
    del words, texts
    begins = [_begin(n) for n in range(1, order)]
    grams, size, fail, source, ends, begun = automaton_of(grams_of(tokens, first, order), first, begins)
    train = docs["train"].to_numpy(np.float64)
    weight = np.repeat(train, lengths)
    counts = np.zeros(len(grams))
    for e in ends:
        counts += np.bincount(e, weights=weight, minlength=len(grams))
    counts[begun] += train.sum()
    for g, c in zip(answers["grams"], answers["counts"]):
        counts[np.searchsorted(grams, _spread(g, "<u8"))] = _spread(c, "<i8")
    known, learnt = int(answers["known"].sum()), int(answers["tokens"].sum())
    single = counts[ends[0]]
    del ends, weight
    net = Automaton(grams, counts, size, fail, source, known, learnt, order, prior, share)
    del grams, counts, size, fail, source
    start = int(net.place(begins[-1])[0]) if order > 1 else -1         # -1 too if nothing was learnt
    p = net.read(tokens, lengths, start, order)
    base = (single + 0.5) / (learnt + 0.5 * (known + 1))
    return pd.DataFrame({
        "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": lengths,
        "n_known": np.add.reduceat((single > 0).astype(np.int64), first), "train_tokens": learnt,
        "base_score": np.add.reduceat(np.log10(base), first), "score": np.add.reduceat(p, first)})


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER, prior: float = PRIOR,
                    share: float = SHARE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    The model learns from the rows where ``held_out`` is false (null: false).
    Null texts count as empty, which is one token, the end.  Repeated rows
    count and come back as often as they came; with no training row every
    token is unknown; an empty table gives no rows; other columns of ``docs``
    are not read.  N-grams are told apart by 63-bit hashes.
    """
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                    text_or_empty().alias("text"))
    n_bytes, n = x.agg(F.sum(F.octet_length("text").cast("bigint")), F.count(F.lit(1))).first()
    groups = part_count(n_bytes, group_bytes)
    ranges = part_count((n_bytes or 0) // 6 * order, RANGE_GRAMS)
    # the partition of the row goes into the hash, so that equal rows do not meet in one group
    dealt = x.withColumns({"train": ~F.col("held_out"),
                           "grp": F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(groups)).cast("int")})
    dealt = dealt.withColumn("text", zipped("text")).repartition(groups, "grp")
    packets = dealt.mapInPandas(partial(_count, order=order, n_ranges=ranges), _PACKET)
    answers = packets.groupBy("part").applyInPandas(_sum_range, _ANSWER)
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(
        lambda d, a: _score(d, a, order, prior, share), _SCORED)
