import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard
from helpers import empty, odd, odd_rows, SF001, table

from feedspark.llm import secret_scan as S
from feedspark.llm.queries import op5_secrets

SECRET = 'password = "hunter2secret"'


def slow_base(text):
    """The contract's patterns as written, failing matches dropped."""
    text = text or ""
    a = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in a.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans_of_tables_and_odd_rows(spark):
    texts = [r.text for r in table(spark, SF001).collect()] + [r[1] for r in odd_rows()]
    texts += ["secret: token: abcdefgh", "TOKEN='ab'AKIAAKIA" + "X" * 12, "paſſword=abcdef1", "toKen=abcdef1",
              "passwordpassword=======aaaaaa", "apikey\" : 'a.b/c-d_e+=", "f" * 23 + "g" + "0" * 24, "AKIA" + "9" * 15, "AKIA" + "9" * 16]
    for t in texts:
        assert [tuple(s) for s in S.scan(t)[0]] == slow_base(t)


def packed(text):
    raw = text.encode()
    return {"gzip": gzip.compress(raw), "zlib": zlib.compress(raw), "bz2": bz2.compress(raw), "xz": lzma.compress(raw),
            "zstd": zstandard.compress(raw)}


WRAP = {
    "url": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "hex escapes": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    **{k: (lambda t, k=k: base64.b64encode(packed(t)[k]).decode()) for k in packed("")},
}


@pytest.mark.parametrize("inner", WRAP)
@pytest.mark.parametrize("outer", ["", *WRAP])
def test_secret_under_two_layers_maps_to_the_original(inner, outer):
    body = WRAP[inner](f"see {SECRET} ok")
    body = WRAP[outer](body) if outer else body
    text = f"é😀 before {body} after"
    base, spans = S.scan(text)
    own = [s for s in spans if s.kind == "assign"]
    a = text.index(body)
    assert own and all(a <= s.start < s.end <= a + len(body) for s in own)
    assert [s for s in base if s not in spans] == []


def test_exact_spans_through_url_and_base64():
    text = "x %70assword=%68unter2 y"
    assert S.scan(text)[1] == [("assign", 2, 22)]
    body = base64.b64encode(b"abc password=hunter2 xyz").decode()
    a, b = body.index(base64.b64encode(b"abc ").decode()[:5]), len(body)
    got = S.scan(f"<{body}>")[1]
    assert [s.kind for s in got] == ["assign"] and got[0].start == 1 + 5 and 1 + 26 <= got[0].end <= b


def test_deep_nesting_ends_and_maps():
    text = SECRET
    for _ in range(6):
        text = base64.b64encode(gzip.compress(text.encode())).decode()
        text = urllib.parse.quote(text)
    assert S.scan(text)[1] and list(S.layers("%25" * 50))[-1].text


def test_key_outside_the_encoded_value():
    assert ("assign", 0, 21) in S.scan("password=%61%62cdef12")[1]


def test_equal_layers_are_taken_once():
    text = "%41 &#66; " * 20
    seen = [layer.text for layer in S.layers(text)]
    assert len(seen) == len(set(seen)) == 4


def test_redact_overlaps():
    spans = [S.Span("assign", 2, 8), S.Span("hex", 4, 12), S.Span("hex", 12, 13)]
    assert S.redact("ab" + "x" * 11 + "cd", spans, "*") == "ab**cd"
    assert S.redact("plain", []) == "plain"


def test_query_digests(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF001).collect()}
    got = op5_secrets(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        base = slow_base(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in S.KINDS)
        assert r.spans == ",".join("%s:%d:%d" % s for s in S.scan(docs[r.doc_id])[1])


def test_odd_rows_and_redaction(spark):
    df = odd(spark)
    assert S.scan_documents(df).count() == len(odd_rows())
    out = S.redact_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sum(r.text is None for r in rows) == 2
    for r in rows:
        if r.text is not None:
            assert S.scan(r.text)[1] == [] and (r.n_chars is None or r.n_chars == len(r.text))
    assert S.scan_documents(empty(spark)).count() == S.redact_documents(empty(spark)).count() == 0


def test_long_text_is_scanned_in_time():
    text = ("lorem %41 ipsum " + "Zm9vYmFyYmF6cXV4MTIz " + "plainwordsonly " * 5) * 20000
    began = time.time()
    S.scan(text)
    assert time.time() - began < 60


@pytest.mark.parametrize("odd", ["\xa0", "\u202f", "\u3000", "\u200b", "\xad", "\ufeff", "\f", "\x1b[0m", "\0"])
@pytest.mark.parametrize("name", ["base64", *packed("")])
def test_layers_with_unprintable_characters(name, odd):
    body = WRAP[name](f"prix{odd}: 5 {SECRET} ok")
    assert any(s.kind == "assign" for s in S.scan(f"see {body} ok")[1])
    assert S.scan(S.redact(body, S.scan(body)[1]))[1] == []


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, zstandard.compress])
def test_layers_that_are_not_utf8(pack):
    raw = "déjà vu, password=hunter2secret".encode("latin-1")
    assert any(s.kind == "assign" for s in S.scan("see " + base64.b64encode(pack(raw)).decode())[1])
    inner = "déjà ".encode("latin-1") + WRAP["url"](SECRET).encode()
    assert any(s.kind == "assign" for s in S.scan("see " + base64.b64encode(pack(inner)).decode())[1])


PLAIN = base64.b64encode(b"password=hunter2secret").decode()


@pytest.mark.parametrize("before", ["https://example.com/get/", "key-", "sess_", "x", "ab", "abc", "data/a-b_c/"])
@pytest.mark.parametrize("after", ["", "-x", "/more_of_it", "\nnext"])
def test_base64_glued_to_other_characters(before, after):
    for body in (PLAIN, base64.b64encode(b"\xe9 password=hunter2secret").decode()):
        own = [s for s in S.scan(f"see {before}{body}{after} ok")[1] if s.kind == "assign"]
        a = 4 + len(before)
        assert own and all(a <= s.start < s.end <= a + len(body) + len(after) for s in own)


@pytest.mark.parametrize("name", packed(""))
@pytest.mark.parametrize("before", ["", "key-", "a/b_"])
@pytest.mark.parametrize("after", ["", "-tail"])
def test_compressed_base64_glued_to_other_characters(name, before, after):
    body = WRAP[name](f"see {SECRET} ok").rstrip("=")
    own = [s for s in S.scan(f"<{before}{body}{after}>")[1] if s.kind == "assign"]
    assert own and all(1 + len(before) <= s.start < s.end <= 1 + len(before) + len(body) + len(after) for s in own)


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [76, 64, 10])
@pytest.mark.parametrize("name", ["base64", "urlsafe", *packed("")])
def test_base64_over_several_lines(name, width, gap):
    for n in range(40, 46):
        body = WRAP[name]("".join(map(chr, range(60, 60 + n // 2))) + "." * n + SECRET + " and some more text behind it")
        lines = gap.join(body[i:i + width] for i in range(0, len(body), width))
        for before in ("see: ", "attached\n"):
            own = [s for s in S.scan(f"{before}{lines} ok")[1] if s.kind == "assign"]
            assert own and all(len(before) <= s.start < s.end <= len(before) + len(lines) for s in own)


def test_span_of_wrapped_base64_skips_the_break():
    body = base64.b64encode(b"abc password=hunter2 xyz").decode()
    (whole,) = S.scan(f"<{body}>")[1]
    (got,) = S.scan(f"<{body[:12]}\r\n{body[12:]}>")[1]
    assert (got.start, got.end) == (whole.start, whole.end + 2)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_every_member_of_a_compressed_layer(pack):
    raw = pack(b"first ") + pack(b"second ") + pack(f"third {SECRET} ok".encode())
    assert S.unpack(raw) == (f"first second third {SECRET} ok".encode(), True)
    assert S.unpack(pack(b"first ") + SECRET.encode()) == (f"first {SECRET}".encode(), True)
    for body in (base64.b64encode(raw).decode(), "key-" + base64.b64encode(raw).decode()):
        assert any(s.kind == "assign" for s in S.scan(f"see {body} ok")[1])


@pytest.mark.parametrize("escape", ["%{:02x}", "\\x{:02x}"])
@pytest.mark.parametrize("name", packed(""))
def test_compressed_bytes_as_escapes(name, escape):
    body = "".join(escape.format(b) for b in packed(f"see {SECRET} ok")[name])
    assert [s for s in S.scan(f"x {body} y")[1] if s.kind == "assign"] == [("assign", 2, 2 + len(body))]


def test_a_stream_that_holds_itself_ends(monkeypatch):
    monkeypatch.setattr(S, "_stream", lambda raw: (raw, b"") if raw.startswith(b"itself") else None)
    assert S.unpack(b"itself and more") == (b"itself and more", True)
    there, back = b"itself A", b"itself B"
    monkeypatch.setattr(S, "_stream", lambda raw: (back if raw == there else there, b"") if raw else None)
    assert S.unpack(there)[1]
