"""Personal data by offset-preserving deobfuscation.

A text goes through a cascade of transducers: characters (homoglyphs, other
scripts' digits, invisible characters), spelled digits, and spoken or
bracketed "at" and "dot".  Each writes its output and keeps the edits it made,
so a place in the output maps back to the characters it came from.
Identifiers are detected in the text itself (the base spans) and in the
output of the cascade; the spans of the latter are mapped back through all
edits to code points of the text and added to the base spans.

Every pattern takes time linear in the text: none can start inside a run that
it has already failed on.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import text_or_empty

# ---- fixed values (base patterns) ---------------------------------------------
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# ---- fixed values (disguises) -----------------------------------------------------
#: Greek, Cyrillic and other letters that look like a Latin one; compatibility forms come by rule (see fold).
HOMOGLYPHS = dict(zip(
    "АВСЕНІЈКМОРЅТХҮԚԜасеԁһіјкӏмоорԛѕтѵԝхуү" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳ" "ıȷɑɡɩօսհց",
    "ABCEHIJKMOPSTXYQWacedhijklmoopqstvwxyy" "ABEZHIKMNOPTYXaikvopuxcj" "ijagiouhg"))
_DOTS = "。｡·∙‧․٫"
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff]+")
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
REPEATS = {"double": 2, "triple": 3}
LEAST_SPELLED = 3                          # spelled digits of a run, unless "dot" or "plus" is in it
_AT, _DOT = "at|ät|arroba|arobase", "dot|punkt|punto|point"
#: Names that end a domain, wanted where only words say that something is an address.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro mobi app dev io ai co me tv cc xyz online site shop blog cloud tech example test "
    "invalid local de fr es it uk us eu ch at nl be pl pt se no dk fi ie cz ru ua cn jp kr in br mx ca au nz za".split())
# ------------------------------------------------------------------------------
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_REPEATED = "|".join(REPEATS)
_ITEM = rf"(?:(?:(?:{_REPEATED})\x20++)?(?:{_NUMBER})(?!\w)|[0-9]++(?!\w))"
_GAP = rf"(?:\x20++(?:{_DOT})\x20++|[\x20,.()-]{{1,3}})"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus\x20++(?={_ITEM}))?{_ITEM}(?:{_GAP}{_ITEM})++")
_SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus\x20++)|(?:(?P<times>{_REPEATED})\x20++)?(?P<word>(?:{_NUMBER})(?!\w))|(?P<digits>[0-9]++)|(?P<dot>\x20++(?:{_DOT})\x20++)|(?P<gap>[\x20,.()-]+)")
_SPOKEN_WORDS = frozenset(DIGIT_WORDS) | {"plus", *_DOT.split("|")}
_LETTERS = re.compile(r"[^\W\d_]+")
_BRACKETED = re.compile(rf"(?i)(?:\[\x20*(?:(?P<a>{_AT}|@)|{_DOT}|\.)\x20*\]|\(\x20*(?:(?P<b>{_AT}|@)|{_DOT}|\.)\x20*\)|"
                        rf"\{{\x20*(?:(?P<c>{_AT}|@)|{_DOT}|\.)\x20*\}}|<\x20*(?:(?P<d>{_AT}|@)|{_DOT}|\.)\x20*>)\x20*+")
_LABEL_GAP = rf"(?:\x20++(?:{_DOT})\x20++|\x20\.\x20|\.)"
_SAID = re.compile(rf"(?i)(?P<at>(?<!\x20)\x20++(?:{_AT}|@)\x20++|@)(?P<domain>[A-Za-z0-9-]++(?:{_LABEL_GAP}[A-Za-z0-9-]++)++)")
_SAID_DOT = re.compile(rf"(?i)\x20++(?:{_DOT})\x20++|\x20\.\x20")
_ANY_GAP = re.compile(rf"(?i){_LABEL_GAP}")
_DOT_BEFORE = re.compile(rf"(?i)(?<=\x20)(?:{_DOT})\Z")
_MAY_BE_SAID = re.compile(rf"(?i)\x20(?:{_DOT})\x20|\x20@\x20")

Edit = tuple[int, int, str]                # (start, end, what stands there instead)


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    value: str                             # the identifier as it was detected, without disguise


# ---- detection ---------------------------------------------------------------------
def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Around every "@": the run of local characters before it (not into the match before) and the domain behind it."""
    at, until = text.find("@"), 0
    while at >= 0:
        start = at
        while start > until and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AT_DOMAIN.match(text, at)):
            yield start, m.end()
            until = m.end()
        at = text.find("@", at + 1)


def _is_ip(piece: str) -> bool:
    parts = [p.lstrip("0") for p in piece.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(piece: str) -> bool:
    digits = [int(c) for c in piece if c not in " -"] if len(piece) <= 2 * 19 else []
    if not 14 <= len(digits) <= 19:
        return False
    twice = (2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[::-2]) + sum(twice)) % 10 == 0


def _is_phone(piece: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in piece) <= 15


def detect(text: str) -> list[Found]:
    """Identifiers of a text in its own offsets, leftmost and non-overlapping per kind, sorted by start, then kind as listed."""
    spans = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, holds in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m[0])]
    return _sorted(Found(k, a, b, text[a:b]) for k, a, b in spans)


def _sorted(found: Iterable[Found]) -> list[Found]:
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# ---- transducers: each lists its edits, in order and apart from each other --------------
@lru_cache(maxsize=1 << 16)
def fold(c: str) -> str | None:
    """The ASCII character that ``c`` stands for; None if it stands for itself."""
    if c < "\x80":
        return None
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in _DOTS:
        return "."
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    if unicodedata.category(c) == "Pd" or c == "−":
        return "-"
    if unicodedata.category(c) == "Zs":
        return " "
    plain = unicodedata.normalize("NFKD", c)
    plain = HOMOGLYPHS.get(plain, plain)
    return plain if len(plain) == 1 and plain < "\x80" else None


def spelled_digits(text: str) -> list[Edit]:
    """Number words among numbers become digits ("double five": 55), glued to their neighbours; "plus" before many digits becomes "+"."""
    if _SPOKEN_WORDS.isdisjoint(_LETTERS.findall(text.lower())):
        return []
    edits: list[Edit] = []
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, *m.span()))
        times = [REPEATS.get((p["times"] or "").lower(), 1) if p["word"] else 0 for p in parts]
        n = sum(times) + sum(len(p["digits"] or "") for p in parts)
        if sum(times) < LEAST_SPELLED and not any(p["dot"] or p["plus"] for p in parts):
            continue                       # a number word that happens to follow a number
        for i, p in enumerate(parts):
            if p["plus"] and n >= 10:
                edits.append((*p.span(), "+"))
            elif p["word"]:
                edits.append((*p.span(), str(DIGIT_WORDS[p["word"].lower()]) * times[i]))
            elif p["dot"]:
                edits.append((*p.span(), "."))
            elif p["gap"] and "." not in p["gap"] and (parts[i - 1]["word"] or parts[i + 1]["word"]):
                edits.append((*p.span(), ""))
    return edits


def brackets(text: str) -> list[Edit]:
    """"[at]", "(dot)", "{@}", "<.>" and the like become "@" or ".", with the blanks around them."""
    if not any(c in text for c in "[({<"):
        return []
    edits: list[Edit] = []
    for m in _BRACKETED.finditer(text):
        a, until = m.start(), edits[-1][1] if edits else 0
        while a > until and text[a - 1] == " ":
            a -= 1
        edits.append((a, m.end(), "@" if m["a"] or m["b"] or m["c"] or m["d"] else "."))
    return edits


def _said_local(text: str, at: int, until: int) -> list[tuple[int, int]] | None:
    """Spoken dots of the local part that ends at ``at`` (not before ``until``), last one first; None if there is no such part."""
    dots: list[tuple[int, int]] = []
    while True:
        a = at
        while a > until and text[a - 1] in _LOCAL:
            a -= 1
        if a == at:
            return dots[:-1] if dots else None
        at = end = a
        while at > until and text[at - 1] == " ":
            at -= 1
        if at == end or not (m := _DOT_BEFORE.search(text, max(until, at - 6), at)):
            return dots
        at = m.start()
        while at > until and text[at - 1] == " ":
            at -= 1
        dots.append((at, end))


def spoken_addresses(text: str) -> list[Edit]:
    """"name at host dot com", "name @ host . com": if the last label is a top-level domain; a bare "at" needs a spoken dot too."""
    edits: list[Edit] = []
    until = 0
    for m in _SAID.finditer(text) if _MAY_BE_SAID.search(text) else ():
        a, b = m.span("domain")
        gaps = list(_ANY_GAP.finditer(text, a, b))
        ends = [g.start() for g in gaps[1:]] + [b]
        top = [e for g, e in zip(gaps, ends) if text[g.end():e].lower() in TOP_DOMAINS]
        said = [(*x.span(), ".") for x in _SAID_DOT.finditer(text, a, top[-1])] if top else []
        local = _said_local(text, m.start(), until) if said or top and m["at"].strip(" ") == "@" else None
        if local is not None:
            edits += [(*x, ".") for x in reversed(local)]
            edits += [(*m.span("at"), "@")] if m["at"] != "@" else []
            edits += said
        until = b
    return edits


# ---- edits and their way back -------------------------------------------------------
class Traced(NamedTuple):
    """A text after edits; per edit where its output starts and ends, and where its input did."""

    text: str
    out_start: list[int]
    out_end: list[int]
    in_start: list[int]
    in_end: list[int]

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Where in the input the output's characters a to b (exclusive) came from."""
        i = bisect_right(self.out_start, a) - 1
        start = a if i < 0 else self.in_start[i] if a < self.out_end[i] else a - self.out_end[i] + self.in_end[i]
        last = b - 1
        i = bisect_right(self.out_start, last) - 1
        end = b if i < 0 else self.in_end[i] if last < self.out_end[i] else b - self.out_end[i] + self.in_end[i]
        return start, end


def apply(text: str, edits: list[Edit]) -> Traced:
    out, done, at, size = [], Traced("", [], [], [], []), 0, 0
    for a, b, new in edits:
        out += [text[at:a], new]
        size += a - at
        done.out_start.append(size)
        size += len(new)
        done.out_end.append(size)
        done.in_start.append(a)
        done.in_end.append(b)
        at = b
    return done._replace(text="".join([*out, text[at:]]))


CASCADE: tuple[Callable[[str], list[Edit]], ...] = (
    lambda t: [] if t.isascii() else [(*m.span(), "") for m in _INVISIBLE.finditer(t)], spelled_digits, brackets, spoken_addresses)


def normalise(text: str) -> tuple[str, list[Traced]]:
    """The text without disguises, and the steps that led there (characters stand one for one before them)."""
    if not text.isascii():
        odd = {ord(c): x for c in set(text) if (x := fold(c)) is not None}
        text = text.translate(odd) if odd else text
    steps = []
    for transducer in CASCADE:
        if edits := transducer(text):
            steps.append(apply(text, edits))
            text = steps[-1].text
    return text, steps


def find(text: str | None) -> tuple[list[Found], list[Found]]:
    """(base finds, all finds) of a text, each sorted by start, then kind as listed, then end."""
    text = text or ""
    base = detect(text)
    plain, steps = normalise(text)
    if plain == text:
        return base, base
    more: dict[tuple[str, int, int], Found] = {}
    for s in detect(plain):
        a, b = s.start, s.end
        for step in reversed(steps):
            a, b = step.back(a, b)
        more[s.kind, a, b] = Found(s.kind, a, b, s.value)
    for kind in KINDS:                     # what a base span of its kind covers is known already
        own = [s for s in base if s.kind == kind]
        starts = [s.start for s in own]
        for key in [k for k in more if k[0] == kind]:
            i = bisect_right(starts, key[1]) - 1
            if i >= 0 and key[2] <= own[i].end:
                del more[key]
    return base, _sorted([*base, *more.values()])


def mask(text: str, found: list[Found]) -> str:
    """The text with every find, or run of overlapping finds, replaced by the kind of its first one in brackets."""
    out, at, until = [], 0, -1
    for s in found:
        if s.start >= until:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
            until = s.end
        until = max(until, s.end)
        at = until
    return "".join([*out, text[at:]]) if out else text


def find_documents(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with column ``out``: (base, spans), both arrays of (kind, start, end, value); null or empty text: empty arrays.

    Offsets are code points, end exclusive; ``value`` is the identifier
    without its disguise.  Every row is read whole and for itself, map only, in
    time linear in its text; finds that tie in their start come in the order
    of ``KINDS``; repeated rows come back as they came, nulls in other columns
    stay; an empty table gives no rows; of the other columns only one named
    ``out`` is replaced.
    """
    span = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    @F.pandas_udf(f"struct<base:{span},spans:{span}>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [find(t) for t in texts]
        listed = lambda spans: [s._asdict() for s in spans]
        return pd.DataFrame({"base": [listed(b) for b, _ in found], "spans": [listed(s) for _, s in found]})

    return docs.withColumn(out, of(text_or_empty(text)))


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all personal data in ``text`` masked by kind; null texts stay null."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else mask(t, find(t)[1]) for t in texts], dtype=object)

    return docs.withColumn(text, masked(F.col(text).cast("string")))
