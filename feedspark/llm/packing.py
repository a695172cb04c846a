"""Hierarchical multi-length packing of tokenized documents.

Routing.  A document's ids are cut into full windows of the longest tier; the
rest goes to the shortest tier that holds it.  Packing, longest tier first: a
window is opened with the longest rest of its tier, its gap is filled with
whole rests of shorter tiers, best fit first, and what is left of the gap with
a cut from a shorter rest (or, when there is none, from the tier's own rests);
the cut-off part is routed again.  A window that cannot be filled is cut back
into shorter tiers.  So all windows are full but a rest below the shortest
tier per task; these rests meet in a second, small pass.

Balance.  Windows of one tier are sorted by attention cost (sum of squared
piece lengths) and grouped in that order, so the members of a step group cost
about the same.

Each task packs its own partition in bounded pools: no shuffle of texts or
ids, no join.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import partial
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import materialize, text_or_empty
from feedspark.llm.token_counts import batches

TIERS = (256, 512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 1 << 21                      # ids that wait in a task's pool
BATCH_CHARS = 1 << 22                      # characters whose words are told apart at once
STEP = 8                                   # windows in a step group
RESTS = 1024                               # tasks whose rests meet in one group of the second pass
_PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, tier int, step_group bigint, open boolean, ids binary")
_LETTER_MARK = re.compile(r"([a-z])(?=[!-&(-/:-@\[-`{-~])")
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, each distinct word coded once within a bounded memory.

    The vocabulary's normalizer is local and lower-cases, its pre-tokenizer
    drops white space and parts a letter from a punctuation mark behind it (but
    for the apostrophe), and it never joins characters across either place.  So
    the ids of a text are those of its lower-cased parts in order.  Texts that
    may hold a special token's string are parted at white space only.  Parts of
    plain letters are coded many at once: each ends with the one id that marks
    a word's end.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}   # of a word or part; its ids are flat[start[n]:start[n + 1]]
        self.flat, self.start = array("I"), array("q", [0])

    def _add(self, words: list[str], ids: bytes, sizes: np.ndarray) -> None:
        """Words with their ids one after the other, ``sizes`` ids each."""
        self.number.update(zip(words, count(len(self.number))))
        self.start.frombytes((self.start[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids)

    def _code(self, parts: list[str]) -> None:
        coded = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        self._add(parts, b"".join(c.tobytes() for c in coded), np.array([len(c) for c in coded], np.int64))

    def _code_letters(self, parts: list[str]) -> None:
        runs = [parts[at:at + 256] for at in range(0, len(parts), 256)]
        coded = self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)
        for run, e in zip(runs, coded):
            ids = np.array(e.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(run):
                self._add(run, ids.tobytes(), np.diff(last, prepend=0))
            else:                          # a letter that falls into letter and mark when lower-cased
                self._code(run)

    def _learn(self, new: list[str]) -> None:
        plain, mixed = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        marked = _LETTER_MARK.sub(r"\1 ", "\n".join(mixed)).split("\n")
        split = [(w,) if "<|" in w else m.split(" ") for w, m in zip(mixed, marked)]
        need = set(plain).union(*split).difference(self.number)
        self._code_letters([p for p in need if p.isalpha()])
        self._code([p for p in need if not p.isalpha()])
        joint = [(w, own) for w, own in zip(mixed, split) if w not in self.number]
        ids = [b"".join(self.flat[self.start[n]:self.start[n + 1]].tobytes() for n in map(self.number.__getitem__, own))
               for _, own in joint]
        self._add([w for w, _ in joint], b"".join(ids), np.array([len(i) // 4 for i in ids], np.int64))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the words of all of them are told apart at once."""
        if len(self.number) > self.most:
            self._forget()
        column = pa.array(texts, pa.string())
        lower = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        words = pc.ascii_split_whitespace(lower)   # ASCII case and ASCII white space only
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(unknown := np.flatnonzero(number < 0)):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(new)
            number[unknown] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        number = number[coded.indices.to_numpy()]
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)
        at, n = start[number], start[number + 1] - start[number]
        until = np.cumsum(n)
        ids = flat[np.repeat(at - (until - n), n) + np.arange(until[-1] if len(until) else 0)].astype("<u4").tobytes()
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        cuts = (4 * np.concatenate([[0], until])[offsets]).tolist()
        del start, flat                    # the arrays may grow again
        end = END_ID.to_bytes(4, "little")
        return [ids[a:b] + end for a, b in zip(cuts, cuts[1:])]


class Piece:
    """A run of a document's ids."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: tuple, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, n), Piece(self.doc, self.start + n, self.length - n)

    def __lt__(self, other: Piece) -> bool:
        return self.length < other.length


def pack_pool(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full windows as (tier, pieces), rest): the rest holds fewer ids than the shortest tier."""
    pool, windows = sorted(pieces), []
    for size, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while pool and pool[-1].length > below:
            window, gap = [], size
            while gap and pool:
                # the tier's own longest rest opens the window; then shorter ones, best fit first
                at = bisect_right(pool, gap, key=lambda p: p.length, hi=None if not window else _shorter(pool, below, gap))
                if at:
                    window.append(pool.pop(at - 1))
                else:                      # nothing fits: cut the shortest one
                    head, tail = pool.pop(0).cut(gap)
                    window.append(head)
                    insort(pool, tail)
                gap -= window[-1].length
            if gap:                        # nothing is left: shorter tiers take it
                open_ = window
                for t in reversed([t for t in tiers if t <= size - gap]):
                    if sum(p.length for p in open_) >= t:
                        window, open_ = _split(open_, t)
                        windows.append((t, window))
                return windows, open_
            windows.append((size, window))
    return windows, pool


def _shorter(pool: list[Piece], below: int, gap: int) -> int | None:
    """Where the pieces of shorter tiers end in the sorted pool; the whole pool if there is none."""
    return bisect_right(pool, below, key=lambda p: p.length) or None


def _split(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``n`` ids, and the others."""
    head: list[Piece] = []
    for i, p in enumerate(pieces):
        if p.length > n:
            a, b = p.cut(n) if n else (None, p)
            return head + ([a] if a else []), [b, *pieces[i + 1:]]
        head.append(p)
        n -= p.length
    return head, []


def _rows(windows: list[tuple[int, list[Piece]]], rest: list[Piece], number, with_ids: bool, last: bool) -> pd.DataFrame:
    """Result rows of packed windows in balanced step groups, and of the rest (open, or padded if ``last``)."""
    out = []

    def put(tier: int, pieces: list[Piece], step: int, open_: bool) -> None:
        seq, at = next(number), 0
        for p in pieces:
            doc_id, ids, doc_tokens, base = p.doc
            own = ids[4 * (p.start - base):4 * (p.start - base + p.length)]
            out.append((doc_id, p.start, p.length, zlib.crc32(own), doc_tokens, seq, at, tier, step, open_,
                        own if with_ids or open_ else None))
            at += p.length

    by_tier: dict[int, list] = {}
    for tier, pieces in windows:
        by_tier.setdefault(tier, []).append((sum(p.length ** 2 for p in pieces), pieces))
    for tier, own in sorted(by_tier.items()):
        own.sort(key=lambda x: x[0])
        for i, (_, pieces) in enumerate(own):
            if i % STEP == 0:
                step = next(number)
            put(tier, pieces, step, False)
    if rest:
        put(TIERS[-1], rest, next(number), not last)
    df = pd.DataFrame(out, columns=_NAMES)
    return df.astype({"doc_id": "Int64"})


def _coded(pdf: pd.DataFrame, encode: WordIds) -> Iterator[tuple]:
    texts = pdf["text"].tolist()
    for a, b in batches(list(map(len, texts)), BATCH_CHARS):
        yield from zip(pdf["doc_id"].iloc[a:b], encode(texts[a:b]))


def _pack_task(batches: Iterator[pd.DataFrame], path: str, with_ids: bool) -> Iterator[pd.DataFrame]:
    encode, longest = WordIds(path), TIERS[-1]
    number = count(TaskContext.get().partitionId() << 40)
    full: list[tuple[int, list[Piece]]] = []
    pool: list[Piece] = []
    held = 0
    for doc_id, ids in (x for pdf in batches for x in _coded(pdf, encode)):
        n = len(ids) // 4
        doc = (None if pd.isna(doc_id) else int(doc_id), ids, n, 0)
        full += [(longest, [Piece(doc, s, longest)]) for s in range(0, n - longest + 1, longest)]
        if tail := n % longest:
            pool.append(Piece(doc, n - tail, tail))
        held += n
        if held >= POOL_TOKENS:
            windows, pool = pack_pool(pool)
            yield _rows(full + windows, [], number, with_ids, False)
            full, held = [], sum(p.length for p in pool)
    windows, pool = pack_pool(pool)
    yield _rows(full + windows, pool, number, with_ids, False)


def _pack_rests(pdf: pd.DataFrame, with_ids: bool) -> pd.DataFrame:
    """The rests of up to ``RESTS`` tasks in common windows; the last one may be padded."""
    number = count(-1 - (int(pdf["cell"].iat[0]) + 1 << 40))
    pieces = [Piece((None if pd.isna(d) else int(d), ids, int(n), int(s)), int(s), int(k)) for d, s, k, n, ids in
              zip(pdf["doc_id"], pdf["start"], pdf["length"], pdf["doc_tokens"], pdf["ids"])]
    windows, rest = pack_pool(pieces)
    return _rows(windows, rest, number, with_ids, True)


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids).

    Every id of every document, with the end id behind it, lies in exactly one
    piece; pieces of one sequence follow each other from offset 0.  Sequences
    are as long as their tier, but for one padded rest per ``RESTS`` tasks.
    Null and empty texts are the end id alone; repeated rows are packed each;
    an empty table gives no rows; other columns of ``docs`` are not read.
    ``with_ids`` adds the ids themselves as little-endian 32-bit numbers.
    """
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    first = materialize(x.mapInPandas(partial(_pack_task, path=path, with_ids=with_ids), _PIECES), "pieces")
    rests = first.where("open").withColumn("cell", F.expr(f"shiftright(sequence_id, 40) div {RESTS}"))
    met = rests.groupBy("cell").applyInPandas(partial(_pack_rests, with_ids=with_ids), _PIECES)
    return first.where("not open").unionByName(met).drop("open", *([] if with_ids else ["ids"]))
