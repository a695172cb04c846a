"""Secret scan with a recursive decoding worklist.

The text is layer 0.  Every layer is scanned by the base patterns.  Each of
the decoders (URL escapes, Unicode escapes, base64, wrapped or not, with any
compression under it) that finds something to unwrap makes one child layer: the
layer's text with its encoded pieces replaced in place.  Base64 glued to other
characters of its alphabet makes one more, with every reading of those runs.
Children go on the worklist until no
decoder changes anything; a layer whose text was seen before in this document
is not taken again, so loops end and decoders that commute meet.  Each
character of a layer knows the span of the original text that it came from, so
a find in any layer is reported as a span of the original.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import text_or_empty

# ---- fixed values (base patterns) ---------------------------------------------
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")      # AKIA[A-Z0-9]+ of 20 or more characters
_HEX = re.compile(r"[0-9a-f]{24,}")             # [0-9a-f]+ of 24 or more characters
# ---- fixed values (encodings) ---------------------------------------------------
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"[ \t]*(?:\r\n?|\n)[ \t]*"
_JOINED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]++(?={_BREAK}[A-Za-z0-9+/_-]))"
                    rf"(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}")
_LEAST_BASE64 = 16
_MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor),
          (b"\x28\xb5\x2f\xfd", lambda: _zstd()),
          (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj), (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj))
# ------------------------------------------------------------------------------
_MAGICS = re.compile(b"|".join(re.escape(magic) for magic, _ in _MAGIC))
_GAPS = re.compile(r"\s+")
_LEFT_OVER = {0xDC00 + b: b for b in range(0x80, 0x100)}     # bytes that aren't UTF-8, as Python escapes them


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def base_spans(text: str) -> list[Span]:
    """Spans of one layer in its own offsets, leftmost and non-overlapping per kind."""
    found = [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _ASSIGN_LEAST]
    found += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class Layer(NamedTuple):
    """A text and, per character, the span of the original that it came from (None: the original itself)."""

    text: str
    start: np.ndarray | None
    end: np.ndarray | None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def _chars(raw: bytes) -> tuple[str, np.ndarray, bool]:
    """The text of bytes, the first byte of each character, and whether all of it is UTF-8; bytes left over are Latin-1."""
    try:
        return raw.decode("utf-8"), np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), True
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    size[code >> 8 == 0xDC] = 1
    return text.translate(_LEFT_OVER), np.cumsum(size) - size, False


def _url(piece: str):
    """URL escapes: three characters a byte; bytes that aren't UTF-8 stand for Latin-1 characters, unless they are compressed."""
    raw = bytes.fromhex(piece.replace("%", ""))
    plain, packed = unpack(raw)
    if packed:
        return _chars(plain)[0], None, None
    try:
        text = raw.decode("utf-8")
        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text, first = raw.decode("latin-1"), np.arange(len(raw))
    return text, 3 * first, 3 * np.append(first[1:], len(raw))


def _unicode(piece: str):
    if piece.startswith("\\x"):
        return _url(piece.replace("\\x", "%"))[0], None, None
    if piece.startswith("\\u") and not piece.startswith("\\u{"):
        raw = bytes.fromhex(piece.replace("\\u", ""))
        text = raw.decode("utf-16-be", "replace")
        units = np.array([2 if ord(c) > 0xFFFF else 1 for c in text])
        at = 6 * np.cumsum(units)
        return text, at - 6 * units, at
    body = piece.strip("\\Uu{}&#;")
    code = int(body[1:], 16) if body[:1] in "xX" else int(body, 10 if piece[0] == "&" else 16)
    return (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"), None, None


def _stream(raw: bytes) -> tuple[bytes, bytes] | None:
    """The content of the compressed stream that the bytes begin with, and what follows it."""
    for magic, make in _MAGIC:
        if raw.startswith(magic):
            undo = make()
            try:
                plain = undo.decompress(raw)
            except Exception:              # not such a stream after all: each library raises its own kind
                continue
            if undo.eof:
                return plain, undo.unused_data
    return None


def unpack(raw: bytes) -> tuple[bytes, bool]:
    """Compressed layers taken off one by one, and whether there was one; a stream that holds itself ends the chain."""
    packed, seen = False, set()
    while (got := _stream(raw)) is not None:
        mark = hashlib.blake2b(raw, digest_size=16).digest()
        if mark in seen:
            break
        seen.add(mark)
        parts, rest = [got[0]], got[1]
        while (got := _stream(rest.lstrip(b"\0"))) is not None:    # further members or frames, padded with zeros or not
            parts.append(got[0])
            rest = got[1]
        raw, packed = b"".join([*parts, rest]), True
    return raw, packed


def _b64(piece: str):
    body = piece.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    plain, packed = unpack(raw)
    text, first, clean = _chars(plain)
    if packed:                             # its magic and its checksum say that it is one, whatever it holds
        return text, None, None
    if not clean:                          # a word that looks like base64, or one that is glued to some: see _glued
        return None
    last = np.append(first[1:], len(raw))
    return text, first * 4 // 3, np.minimum(-(-last * 4 // 3), len(piece))


def _joined(piece: str):
    """Base64 that may go over several lines, read as one."""
    body = _GAPS.sub("", piece)
    if len(body.rstrip("=")) < _LEAST_BASE64:
        return None
    if (got := _b64(body)) is None or got[1] is None or len(body) == len(piece):
        return got
    at = np.flatnonzero([not c.isspace() for c in piece])
    return got[0], at[got[1]], at[got[2] - 1] + 1


def _base64_pieces(text: str) -> Iterator[tuple]:
    for m in _JOINED.finditer(text):
        if (got := _joined(m[0])) is not None:
            yield *m.span(), got
        else:                              # lines that don't belong together
            yield from _pieces(_BASE64, _b64, text, *m.span())


def _glued(layer: Layer) -> Layer | None:
    """Base64 that does not begin with its run of characters, or does not end with it.

    Wherever base64 begins in a run, it is read right from one of the run's
    first four characters, with noise around it.  The layer holds all four
    readings of all runs (the first one only where the run as a whole is no
    base64), parted by NUL bytes; compressed data is unpacked where it begins.
    Bytes stand for Latin-1 characters, since all patterns are ASCII.
    """
    bodies, places = ([], [], [], []), ([], [], [], [])
    for m in _JOINED.finditer(layer.text):
        piece = m[0].rstrip("=")
        at = np.arange(m.start(), m.start() + len(piece))
        body = _GAPS.sub("", piece)
        if len(body) < _LEAST_BASE64:
            continue
        if len(body) < len(piece):
            at = at[[not c.isspace() for c in piece]]
        for k in range(0 if _joined(m[0]) is None else 1, 4):
            fill = 4 + -(len(body) - k) % 4
            bodies[k].append(body[k:] + "A" * fill)
            places[k].append(at[k:])
            places[k].append(np.full(fill, at[-1]))
    if not bodies[3]:
        return None
    place = np.concatenate([x for own in places for x in own])
    raw = base64.b64decode("".join(x for own in bodies for x in own).replace("-", "+").replace("_", "/"))
    byte = np.arange(len(raw))
    first = byte // 3 * 4 + byte % 3
    start, end = place[first], place[first + 1] + 1
    if layer.start is not None:
        start, end = layer.start[start], layer.end[end - 1]
    texts, starts, ends, until = [raw.decode("latin-1")], [start], [end], 0
    for m in _MAGICS.finditer(raw):
        if m.start() < until or (got := _stream(raw[m.start():])) is None:
            continue
        until = len(raw) - len(got[1])
        text = "\0" + _chars(unpack(got[0])[0])[0]
        texts.append(text)
        starts.append(np.full(len(text), start[m.start():until].min()))
        ends.append(np.full(len(text), end[m.start():until].max()))
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))


def _pieces(pattern: re.Pattern, read, text: str, *within: int) -> Iterator[tuple]:
    """(begin, end, what was read) of every piece that ``read`` can decode."""
    for m in pattern.finditer(text, *within):
        if (got := read(m[0])) is not None:
            yield *m.span(), got


#: (the pieces of a text with what is read there, a cheap test whether a text can hold such a piece)
DECODERS = (
    (partial(_pieces, _URL, _url), lambda t: "%" in t),
    (partial(_pieces, _UNICODE, _unicode), lambda t: "\\" in t or "&#" in t),
    (_base64_pieces, lambda t: True),
)


def _child(layer: Layer, pieces) -> Layer | None:
    """The layer with every piece that can be decoded replaced in place; None if there is none."""
    texts, starts, ends, at = [], [], [], 0
    for a, b, (text, first, last) in pieces(layer.text):
        texts.append(layer.text[at:a])     # what stands between the pieces keeps its origin
        starts.append(np.arange(at, a) if layer.start is None else layer.start[at:a])
        ends.append(np.arange(at + 1, a + 1) if layer.start is None else layer.end[at:a])
        texts.append(text)
        if layer.start is None and first is not None:
            starts.append(a + first)
            ends.append(a + last)
        elif first is not None:
            starts.append(np.minimum.reduceat(layer.start[a:b], first) if len(first) else first)
            ends.append(np.array([layer.end[a + x:a + y].max() for x, y in zip(first, last)], dtype=np.int64))
        else:
            lo, hi = layer.origin(a, b)
            starts.append(np.full(len(text), lo))
            ends.append(np.full(len(text), hi))
        at = b
    if not texts:
        return None
    n = len(layer.text)
    texts.append(layer.text[at:])
    starts.append(np.arange(at, n) if layer.start is None else layer.start[at:])
    ends.append(np.arange(at + 1, n + 1) if layer.start is None else layer.end[at:])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))


def layers(text: str) -> Iterator[Layer]:
    """The text and every layer under it, each different text once."""
    todo, seen = [Layer(text, None, None)], None
    while todo:
        layer = todo.pop()
        yield layer
        children = [_child(layer, pieces) for pieces, may in DECODERS if may(layer.text)]
        for child in [*children, _glued(layer)]:
            if child is not None:
                seen = seen or {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
                mark = hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    todo.append(child)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each sorted by start, then kind as listed, then end."""
    text = text or ""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s.start, rank[s.kind], s.end)
    base: list[Span] = []
    more: set[Span] = set()
    for i, layer in enumerate(layers(text)):
        found = base_spans(layer.text)
        if i == 0:
            base = sorted(found, key=order)
        else:
            more |= {Span(s.kind, *layer.origin(s.start, s.end)) for s in found}
    return base, sorted({*base, *more}, key=order) if more else base


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    out, at, until = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s.start):
        if a >= until:
            out += [text[at:a], mark]
            until = b
        until = max(until, b)
        at = until
    return "".join([*out, text[at:]]) if out else text


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``secrets``: (base, spans), both arrays of (kind, start, end); null text: empty arrays.

    Offsets are code points, end exclusive.  Every row is scanned whole and
    for itself, map only; repeated rows come back as they came; an empty table
    gives no rows; a column named ``secrets`` is replaced.
    """
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.pandas_udf(f"struct<base:{span},spans:{span}>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [scan(t) for t in texts]
        listed = lambda spans: [s._asdict() for s in spans]
        return pd.DataFrame({"base": [listed(b) for b, _ in found], "spans": [listed(s) for _, s in found]})

    return docs.withColumn("secrets", of(text_or_empty(text)))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` masked and ``n_chars`` brought up to date; null texts stay null."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redact(t, scan(t)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out
