"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel.  A token that may be disguised (leetspeak, separators between
letters, letters repeated, or a run of single letters set apart by spaces)
becomes a lattice: every position offers letters, and nothing, at a price.
Viterbi over the lattice, with the last two letters as state and a character
trigram model of all words as prior, gives the most likely plain spelling.
Tokens of plain letters without a double are lattices with one path and need no search.

Score.  Restored words have features (the word and its prefixes) in a hashed
table of fixed size.  The table counts labelled training documents with and
without the label per feature; the evidence of a word is that of its most
telling feature.  A document's score is a logistic function of its three
strongest words, fitted with every document's own label taken out of the
counts it is judged by.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import id_fold, materialize, text_or_empty, zipped
from feedspark.llm.token_counts import batches as runs

# ---- fixed values (the channel) ---------------------------------------------------
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~·'"
# ------------------------------------------------------------------------------
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}     # 0: edge of a word, 1: any other letter
BASE = len(ALPHABET) + 2
#: Log prices: a letter for a symbol; a symbol that stands for letters lost, another one lost; a separator lost; a word ends
#: between spaced letters; one more repeat lost; a double letter made single.
SWAP, LOST, DROP, JOIN, PART, FOLD, SINGLE = -1.5, -7.0, -3.0, -0.5, -5.0, -0.3, -2.0
FEATURES = 1 << 20                                     # size of the hashed feature table
PREFIXES = (3, 4, 5, 6)
SHRINK = 5.0                                           # pseudo-documents that pull a rare feature's evidence to none
TOP = 3
FIT_ROWS = 20_000                                      # bound of the labelled sample that the logistic curve is fitted on

_TRIM = "".join(chr(c) for c in range(0x21, 0xC0) if not chr(c).isalnum()) + "‘’“”„…–—•"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"(.)\1")
_THRICE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_GAP = re.compile(r"\s+")
_LEET = frozenset(LEET)


# ---- the character model ------------------------------------------------------------
_TABLE = np.ones(0x100, np.int64)          # code of each character below 0x100; 0: edge of a word, 1: any other letter
_TABLE[ord(" ")] = 0
for _c, _k in _CODE.items():
    _TABLE[ord(_c)] = _k


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 0 white space, 1 letter, 2 what is stripped from a word, 3 anything else."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            kinds[ord(c)] = 1
        elif c.isspace():
            kinds[ord(c)] = 0
    kinds[[ord(c) for c in _TRIM]] = 2
    return kinds


def add_trigrams(total: np.ndarray, text: str) -> None:
    """Add the letter trigrams (two edges, the letters, an edge) of all words that are letters with marks around them at most."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    letter = kind == 1
    inside = kind != 0
    token = np.cumsum(inside[1:] & ~inside[:-1])       # of the character behind; 0 stands before the first one
    token = np.concatenate([[0], token])
    runs_in = np.bincount(token[1:][letter[1:] & ~letter[:-1]], minlength=token[-1] + 1)
    others = np.bincount(token[kind == 3], minlength=token[-1] + 1)
    at = np.flatnonzero(letter & ((runs_in == 1) & (others == 0))[token])
    code = np.where(points < 0x100, _TABLE[np.minimum(points, 0xFF)], 1) * letter
    c, b = code[at], code[at - 1]
    a = code[np.maximum(at - 2, 0)] * (b > 0)
    total += np.bincount((a * BASE + b) * BASE + c, minlength=BASE ** 3)
    last = ~letter[at + 1]
    total += np.bincount((b[last] * BASE + c[last]) * BASE, minlength=BASE ** 3)


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BASE ** 3, np.int64)
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in runs(list(map(len, texts)), 1 << 21):
            add_trigrams(total, "\n".join(texts[a:b]))
    used = np.flatnonzero(total)
    yield pd.DataFrame({"gram": used, "n": total[used]})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two letters before) from the words of all documents, as a table of BASE^3 entries."""
    x = docs.select(text_or_empty().alias("text")).mapInPandas(_count_trigrams, "gram bigint, n bigint")
    counts = np.zeros(BASE ** 3)
    for r in x.groupBy("gram").agg(F.sum("n").alias("n")).collect():   # BASE^3 rows at most, whatever the corpus
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(BASE, BASE, BASE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * BASE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _readings(token: str) -> list[tuple[str, bool]]:
    """What a token may be read as: (part of it, whether that is to be restored)."""
    token = token[:-1] if token[-1:] in ".,;:?" else token
    bare = _EDGE.sub("", token)
    if not bare.isalpha():
        found = [(bare, False)]
    elif _THRICE.search(bare):
        found = [(bare, True)]
    else:
        found = [(bare, False), (bare, True)] if _TWICE.search(bare) else [(bare, False)]
    if _LETTER.search(token) or not _LEET.isdisjoint(token):
        inner = token.rstrip(".,;:?!")                  # symbols at the edge may be letters too
        found += [(t, True) for t in dict.fromkeys((inner, token)) if t != bare or not bare.isalpha()]
    return found


_IS_LEET = np.array([chr(c) in _LEET for c in range(0x100)])
_MARKS = "".join(c for c in map(chr, range(1, 0x100)) if not c.isalpha() and c not in LEET and c != " ")
_MARK_PRICE = np.array([0.0 if chr(c) in LEET else JOIN if chr(c) in SEPARATORS else DROP for c in range(0x100)])
_IS_COMMON = re.compile(f"[{ALPHABET}{re.escape(_MARKS)}]*+(?:([{re.escape(''.join(c for c in LEET if c < chr(0x100)))}])\\1*)?").fullmatch


class Channel:
    """Restores disguised tokens under a character model."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per run of equal characters the options (letters, price); a space may close or part words."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            once = 0.0 if n == 1 else SINGLE if n == 2 else FOLD * (n - 1)
            twice = FOLD * (n - 2)
            if c == " ":
                options = [("", 0.0), (" ", PART)]
            elif c.isalpha():
                options = [(c, once)] + ([(c * 2, twice)] if n > 1 else [])
            else:
                options = [("", JOIN if c in SEPARATORS else LOST if c in LEET else DROP)]
                for x in LEET.get(c, ""):
                    options += [(x, SWAP + once)] + ([(x * 2, 2 * SWAP + twice)] if n > 1 else [])
            out.append(options)
            i = j
        return out

    def restore(self, token: str) -> str:
        """The most likely plain spelling of a token (or of letters set apart by spaces: of all of them)."""
        best = {(0, 0): (0.0, None)}       # per state the score, and the letters as (what went before, last ones)
        for options in self.lattice(token):
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, done) in best.items():
                for letters, price in options:
                    s, x, y = score + price, a, b
                    for c in letters:
                        k = 0 if c == " " else _CODE.get(c, 1)
                        s += float(self.logp[x, y, k])
                        x, y = (0, 0) if c == " " else (y, k)
                    if (x, y) not in nxt or nxt[x, y][0] < s:
                        nxt[x, y] = s, (done, letters) if letters else done
            best = nxt
        done = max(((s + float(self.logp[a, b, 0]), w) for (a, b), (s, w) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while done:
            done, last = done
            letters.append(last)
        return "".join(reversed(letters))

    def restore_common(self, text: np.ndarray) -> np.ndarray:
        """``restore`` of tokens of letters and marks, the last run of which may be a leetspeak symbol, all at once.

        Tokens and spellings are Latin-1 characters with a NUL behind each; no token is empty.

        After a run of letters the state is one of two: the run was made
        single, or double; marks are dropped and leave the state.  Scores are
        added up in the order in which ``restore`` adds them, and of equal ones
        the first is kept, so both give the same spelling.
        """
        start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        char, n = text[start].copy(), np.diff(np.append(start, len(text)))
        size = np.diff(np.concatenate([[-1], np.flatnonzero(char == 0)])) - 1
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        times = np.ones(len(char), np.int64)
        flat = self.logp.ravel()
        p = lambda a, b, c: flat[(a * BASE + b) * BASE + c].astype(np.float64)
        for k in np.unique(size):
            at = first[size == k][:, None] + np.arange(k)
            rows = len(at)
            code, price, count = _TABLE[char[at]], _MARK_PRICE[char[at]], n[at]
            single = np.where(count == 1, 0.0, np.where(count == 2, SINGLE, FOLD * (count - 1)))
            double = np.where(count == 1, -np.inf, FOLD * (count - 2))
            one, two = np.zeros(rows), np.full(rows, -np.inf)
            a, b = np.zeros(rows, np.int64), np.zeros(rows, np.int64)      # the letters before: (a, b) or, in state two, (b, b)
            came = np.zeros((2, k, rows), bool)        # per state: whether the state before was two
            for r in range(k):
                c, mark = code[:, r], code[:, r] < 2
                from_one, from_two, again = p(a, b, c), p(b, b, c), p(b, c, c)
                s1, s2 = one + single[:, r] + from_one, two + single[:, r] + from_two
                d1, d2 = one + double[:, r] + from_one + again, two + double[:, r] + from_two + again
                came[0, r], came[1, r] = ~mark & (s2 > s1), mark | (d2 > d1)
                one = np.where(mark, one + price[:, r], np.where(came[0, r], s2, s1))
                two = np.where(mark, two + price[:, r], np.where(came[1, r], d2, d1))
                a, b = np.where(mark, a, b), np.where(mark, b, c)
                times[at[:, r]] = ~mark
            best, state, letter, often = np.full(rows, -np.inf), np.zeros(rows, bool), np.zeros(rows, np.uint8), np.zeros(rows, np.int64)

            def offer(score, which, own, x="\0", repeats=0):
                better = score > best[own]
                for kept, new in ((best, score), (state, which), (letter, ord(x)), (often, repeats)):
                    kept[own] = np.where(better, new, kept[own])

            symbol = char[at[:, -1]] if k else np.zeros(rows, np.uint8)
            symbol = np.where(_IS_LEET[symbol], symbol, 0)
            for ch in np.unique(symbol):
                own = np.flatnonzero(symbol == ch)
                lost = LOST if ch else 0.0
                for which, score, x in ((False, one[own], a[own]), (True, two[own], b[own])):
                    y = b[own]
                    offer(score + lost + p(x, y, 0), which, own)
                    for to in LEET[chr(ch)] if ch else "":
                        z = _CODE[to]
                        offer(score + (SWAP + single[own, -1]) + p(x, y, z) + p(y, z, 0), which, own, to, 1)
                        offer(score + (2 * SWAP + double[own, -1]) + p(x, y, z) + p(y, z, z) + p(z, z, 0), which, own, to, 2)
            for r in range(k - 1, -1, -1):
                times[at[:, r]] += state & (code[:, r] >= 2)
                state = np.where(state, came[1, r], came[0, r])
            if k:
                end = np.flatnonzero(symbol)
                char[at[end, -1]], times[at[end, -1]] = letter[end], often[end]
        return np.repeat(char, times)

    def restore_all(self, tokens: Iterable[str]) -> dict[str, str]:
        """``restore`` of every token; those of the common kind go through the lattice together."""
        tokens = list(dict.fromkeys(tokens))
        plain = [t for t in tokens if t and _IS_COMMON(t)]
        text = np.frombuffer("".join(t + "\0" for t in plain).encode("latin-1"), np.uint8)
        out = dict(zip(plain, self.restore_common(text).tobytes().decode("latin-1").split("\0"))) if plain else {}
        out.update((t, self.restore(t)) for t in tokens if t not in out)
        return out

    def words_of(self, tokens: list[str]) -> list[list[str]]:
        """Restored words of every white-space token, lower case."""
        out = [[t] for t in tokens]
        odd = [(i, _readings(t)) for i, t in enumerate(tokens) if not t.isalpha() or _TWICE.search(t)]
        restored = self.restore_all(t for _, plan in odd for t, disguised in plan if disguised)
        for i, plan in odd:
            out[i] = [w for w in dict.fromkeys([restored[t] if disguised else t for t, disguised in plan]) if w]
        return out

    def words(self, token: str) -> list[str]:
        return self.words_of([token])[0]

    def spaced(self, text: str) -> list[str]:
        """Words hidden in runs of single characters set apart by white space of any kind.

        Where most gaps of a run are alike, the others may part words: each part is read by itself too.
        """
        out = []
        for m in _SPACED.finditer(text):
            gaps, letters = _GAP.findall(m[0]), m[0].split()
            usual = Counter(gaps).most_common(1)[0][0]
            cuts = [0, *(i + 1 for i, gap in enumerate(gaps) if gap != usual), len(letters)]
            parts = {" ".join(letters[a:b]) for a, b in zip(cuts, cuts[1:]) if b - a > 2} | {" ".join(letters)}
            for run in sorted(parts):
                if len(set(run)) > 2:      # the blank and two letters: one character repeated is no word
                    out += self.restore(run).split()
        return out


# ---- evidence -----------------------------------------------------------------------
def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: for millions of integers that is several times faster than a hash set)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[:len(x)]]


class Strings:
    """Strings as code points end to end, and where each one starts (and the last one ends)."""

    def __init__(self, points: np.ndarray, at: np.ndarray):
        self.points, self.at = points, at

    @classmethod
    def of(cls, strings: list[str]) -> Strings:
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))]))

    @classmethod
    def of_arrow(cls, strings: pa.LargeStringArray) -> Strings:
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if len(strings) and data else np.zeros(0, np.uint8)
        first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return cls(np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first[at - at[0]])

    def __len__(self) -> int:
        return len(self.at) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def count(self, marks: np.ndarray) -> np.ndarray:
        """How many of a string's characters are marked."""
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def take(self, which: np.ndarray) -> Strings:
        size = self.sizes()[which]
        at = np.concatenate([[0], np.cumsum(size)])
        return Strings(self.points[np.arange(at[-1]) + np.repeat(self.at[which] - at[:-1], size)], at)

    def list(self) -> list[str]:
        text = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a:b] for a, b in zip(self.at.tolist(), self.at[1:].tolist())]

    def __add__(self, other: Strings) -> Strings:
        return Strings(np.concatenate([self.points, other.points]), np.concatenate([self.at, other.at[1:] + self.at[-1]]))


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(words: Strings) -> np.ndarray:
    """Per word its place in the hashed table and those of its prefixes (-1: it is shorter)."""
    size = words.sizes()
    longest = int(size.max(initial=0))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(longest + 1, _STEP, np.uint64))
        place = np.arange(len(words.points)) - np.repeat(words.at[:-1], size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.points.astype(np.uint64) + np.uint64(1)) * power[place])])
        out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
        for column, k in enumerate((None, *PREFIXES)):
            own = np.flatnonzero(size >= (k or 0))
            a = words.at[own]
            h = total[a + k if k else words.at[own + 1]] - total[a] + np.uint64(k or 0)
            h = (h ^ (h >> np.uint64(31))) * _MIX
            h = (h ^ (h >> np.uint64(29))) * _STEP
            out[own, column] = (h >> np.uint64(44)).astype(np.int64) & (FEATURES - 1)
    return out


class Reader:
    """Restored words of texts, each distinct token of a batch decoded once."""

    def __init__(self, logp: np.ndarray):
        self.channel = Channel(logp)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, Strings, np.ndarray]]:
        """For parts of the texts: (text, unit) pairs as two arrays, words, and each word's unit.

        A unit is a distinct token of a text, or a word that it hides in letters set apart by spaces.
        """
        begin = 0
        for a, b in runs(list(map(len, texts)), 1 << 24):
            text, unit, words, owner = self._read(texts[a:b])
            yield text + begin, unit, words, owner
            begin += b - a

    def _read(self, texts: list[str]):
        lower = pc.utf8_lower(pa.array(texts, pa.large_string()))
        for mark in (", ", ". ", ".\n"):   # a stop behind a word says nothing; without it more tokens are equal
            lower = pc.replace_substring(lower, mark, " ")
        pieces = pc.utf8_split_whitespace(lower)
        coded = pieces.flatten().dictionary_encode()
        code, ends = coded.indices.to_numpy().astype(np.int64), pieces.offsets.to_numpy().astype(np.int64)
        tokens = Strings.of_arrow(coded.dictionary.cast(pa.large_string()))
        words, owner = self._words(tokens)
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        alone = (tokens.sizes() == 1)[code]
        # a word of spaced letters has three letters, two of them different
        n = np.bincount(text[alone], minlength=len(texts))
        low, high = np.full(len(texts), len(tokens)), np.full(len(texts), -1)
        np.minimum.at(low, text[alone], code[alone])
        np.maximum.at(high, text[alone], code[alone])
        hidden = [(i, w) for i in np.flatnonzero((n > 2) & (low < high)).tolist() for w in dict.fromkeys(self.channel.spaced(lower[i].as_py())) if w]
        pair = _distinct(text * max(len(tokens), 1) + code)
        text, unit = pair // max(len(tokens), 1), pair % max(len(tokens), 1)
        more = np.arange(len(hidden)) + len(tokens)
        return (np.concatenate([text, np.array([i for i, _ in hidden], np.int64)]), np.concatenate([unit, more]),
                words + Strings.of([w for _, w in hidden]), np.concatenate([owner, more]))

    def _words(self, tokens: Strings) -> tuple[Strings, np.ndarray]:
        """Restored words of tokens, and which token each belongs to."""
        points, size = tokens.points, tokens.sizes()
        known = np.where(points < 0x100, _TABLE[np.minimum(points, 0xFF)], 0) >= 2
        letters = (tokens.count(known) == size) & (size > 0)
        last = np.zeros(len(points), bool)
        last[tokens.at[1:][size > 0] - 1] = True
        twice = np.concatenate([points[1:] == points[:-1], [False]])[:len(points)] & ~last
        thrice = twice & np.concatenate([twice[1:], [False]])[:len(points)]
        doubled, tripled = letters & (tokens.count(twice) > 0), letters & (tokens.count(thrice) > 0)
        bare, odd = np.flatnonzero(letters & ~tripled), np.flatnonzero(~letters)
        restored = np.flatnonzero(doubled)
        own = tokens.take(restored)
        text = np.zeros(len(own.points) + len(own), np.uint8)
        text[np.arange(len(own.points)) + np.repeat(np.arange(len(own)), own.sizes())] = own.points
        spelt = self.channel.restore_common(text) if len(text) else text
        ends = np.flatnonzero(spelt == 0)
        spelt = Strings(spelt[spelt > 0].astype(np.uint32), np.concatenate([[0], ends - np.arange(len(ends))]))
        found = [(t, w) for t, words in zip(odd.tolist(), self.channel.words_of(tokens.take(odd).list())) for w in words]
        words = tokens.take(bare) + spelt + Strings.of([w for _, w in found])
        return words, np.concatenate([bare, restored, np.array([t for t, _ in found], np.int64)])


def evidence(with_label: np.ndarray, without: np.ndarray, prior: float) -> np.ndarray:
    """log of how much likelier the label is given the feature, shrunk towards none for rare features; none counts 0."""
    p = (with_label + SHRINK * prior) / (with_label + without + SHRINK)
    return np.maximum(np.log(p / prior), 0.0)


def _strongest(values) -> list[float]:
    best = sorted(values, reverse=True)[:TOP]
    return best + [0.0] * (TOP - len(best))


def strengths(reader: Reader, table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Evidence of the ``TOP`` strongest units of every text."""
    out = np.zeros((len(texts), TOP))
    table = np.append(table, np.float32(0))            # -1: no such feature
    for text, unit, words, owner in reader(texts):
        value = np.zeros(max(int(unit.max(initial=0)), int(owner.max(initial=0))) + 1)
        np.maximum.at(value, owner, table[features(words)].max(axis=1, initial=0.0))
        some = np.flatnonzero(value[unit] > 0)
        some = some[np.lexsort((-value[unit[some]], text[some]))]
        text, value = text[some], value[unit[some]]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        top = place < TOP
        out[text[top], place[top]] = value[top]
    return out


def feature_sets(reader: Reader, texts: list[str]) -> list[np.ndarray]:
    """The distinct features of every text."""
    out = [np.zeros(0, np.int32)] * len(texts)
    for text, unit, words, owner in reader(texts):
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], features(words)[order]
        a, b = np.searchsorted(owner, unit), np.searchsorted(owner, unit, "right")
        n = b - a
        word = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n)
        pair = (np.repeat(text, n)[:, None] * FEATURES + found[word])[found[word] >= 0]
        pair = _distinct(pair)
        text, first = np.unique(pair // FEATURES, return_index=True)
        for i, own in zip(text.tolist(), np.split((pair % FEATURES).astype(np.int32), first[1:])):
            out[i] = own
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    """Character model, evidence per hashed feature, logistic weights; all of fixed size."""

    def __init__(self, logp: np.ndarray, evidence_table: np.ndarray, weights: np.ndarray):
        self.logp, self.table, self.weights = logp, evidence_table, weights

    def score(self, docs: DataFrame, text: str = "text") -> Column:
        """A column with the score (0 to 1) of ``text``."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((self.logp, self.table, self.weights))   # about 5 MB, whatever the corpus

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            logp, known, w = shared.value
            reader = Reader(logp)
            for texts in batches:
                top = strengths(reader, known, texts.tolist())
                yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + top @ w[1:], -35, 35))))

        return of(text_or_empty(text))


def train(docs: DataFrame, labels: DataFrame, is_training: Column) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of the documents where ``is_training`` holds.

    The character model reads all documents and no label.  Without training
    labels the score is 0.5; without both labels among them it is their rate.
    A document labelled twice counts as toxic if one label says so.
    """
    spark = docs.sparkSession
    logp = character_model(docs)
    shared = spark.sparkContext.broadcast(logp)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("y"))
    # both sides are dealt out by id at every size; the texts travel compressed
    known = docs.where(is_training).select(F.col("doc_id").alias("_id"), zipped(text_or_empty()).alias("text")).join(
        marks.hint("merge"), "_id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        unpack = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                found = feature_sets(reader, [unpack(t).decode("utf-8") for t in part["text"]])
                yield pd.DataFrame({"draw": part["draw"].to_numpy(), "y": part["y"].to_numpy(), "f": found})

    lots = known.select(F.xxhash64("_id").alias("draw"), "y", "text")      # by id: equal texts are drawn one by one
    seen = materialize(lots.mapInPandas(featured, "draw bigint, y int, f array<int>"), "features")
    n, n_toxic = seen.agg(F.count(F.lit(1)), F.sum("y")).first()
    with_label, without = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    if not n or n_toxic in (0, n):
        rate = 0.5 if not n else min(max(n_toxic / n, 1e-6), 1 - 1e-6)
        return ToxicityModel(logp, np.zeros(FEATURES, np.float32), np.array([math.log(rate / (1 - rate)), *[0.0] * TOP]))
    counts = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    counts = counts.where("a > 0").toPandas()          # FEATURES rows at most; a feature never seen with the label has no evidence
    with_label[counts["f"]] = counts["a"]
    without[counts["f"]] = counts["n"] - counts["a"]
    prior = n_toxic / n
    both = spark.sparkContext.broadcast((with_label.astype(np.int32), without.astype(np.int32)))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = both.value
        for pdf in batches:
            rows = []
            for draw, y, f in zip(pdf["draw"], pdf["y"], pdf["f"]):        # as if this document had no label
                f = f[a[f] > y]
                rows.append((draw, int(y), *_strongest(evidence(a[f] - y, b[f] - (1 - y), prior))))
            yield pd.DataFrame(rows, columns=["draw", "y", "e0", "e1", "e2"])

    some = seen.where(F.pmod("draw", F.lit(n)) < FIT_ROWS)
    top = some.mapInPandas(judged, "draw bigint, y int, e0 double, e1 double, e2 double")
    sample = top.orderBy("draw", "y", "e0", "e1", "e2").limit(FIT_ROWS).toPandas()
    weights = _fit(sample[["e0", "e1", "e2"]].to_numpy(), sample["y"].to_numpy())
    return ToxicityModel(logp, evidence(with_label, without, prior).astype(np.float32), weights)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels are learnt from rows outside fold ``held`` of the id's checksum;
    score and prediction depend on the text alone.  Null texts count as empty
    and get the score of a text without evidence; a null id counts as the
    empty text; repeated rows come back as they came; an empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    x = docs.select("doc_id", "text")
    held_out = id_fold("doc_id", folds) == held
    model = train(x, labels, ~held_out)
    out = x.select("doc_id", held_out.alias("held_out"), model.score(x).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
