import hashlib
import random
import re
import time

import pytest
from helpers import CLASHING, SF001, empty, odd, table

from feedspark.llm import pii
from feedspark.llm.queries import op11_pii


def naive(text):
    """The contract's patterns, each as it stands."""
    out = []
    for kind, pattern, holds in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"[^0-9]", "", s)) <= 15)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if holds(m[0])]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def luhn(s):
    digits = re.sub(r"[^0-9]", "", s)[::-1]
    if not 14 <= len(digits) <= 19:
        return False
    total = 0
    for i, c in enumerate(digits):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(found):
    return [(s.kind, s.start, s.end) for s in found]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    for n in range(6000):
        alphabet = ("a@.-%", "0123456789.", "0123456789 -", "+0123456789 ().-", "a@.0123456789+ -()é", "1.@")[n % 6]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert spans(pii.detect(text)) == naive(text), text


@pytest.mark.parametrize("text, piece, kind, value", [
    ("mail jоhn.smith@exаmple.com now", "jоhn.smith@exаmple.com", "email", "john.smith@example.com"),
    ("john [at] example [dot] com.", "john [at] example [dot] com", "email", "john@example.com"),
    ("a john(at)mail{.}example<dot>com", "john(at)mail{.}example<dot>com", "email", "john@mail.example.com"),
    ("to john dot smith at mail dot example dot com please", "john dot smith at mail dot example dot com", "email",
     "john.smith@mail.example.com"),
    ("JOHN  AT  EXAMPLE  DOT  COM", "JOHN  AT  EXAMPLE  DOT  COM", "email", "JOHN@EXAMPLE.COM"),
    ("john @ example . com", "john @ example . com", "email", "john@example.com"),
    ("john@example dot com", "john@example dot com", "email", "john@example.com"),
    ("jo​hn@exam​ple.com​", "jo​hn@exam​ple.com", "email", "john@example.com"),
    ("john＠example．com", "john＠example．com", "email", "john@example.com"),
    ("hans arroba ejemplo punto es", "hans arroba ejemplo punto es", "email", "hans@ejemplo.es"),
    ("x plus one five five five zero one two three four five six y", "plus one five five five zero one two three four five six", "phone",
     "+15550123456"),
    ("call +1 five five five, 012 3456 ok", "+1 five five five, 012 3456", "phone", "+1555012 3456"),
    ("+٤٩ (30) ١٢٣٤٥٦٧", "+٤٩ (30) ١٢٣٤٥٦٧", "phone", "+49 (30) 1234567"),
    ("+49 (0) 30–1234567", "+49 (0) 30–1234567", "phone", "+49 (0) 30-1234567"),
    ("ip 192[.]168[.]0[.]1 x", "192[.]168[.]0[.]1", "ip", "192.168.0.1"),
    ("10 dot 20 dot 30 dot 40", "10 dot 20 dot 30 dot 40", "ip", "10.20.30.40"),
    ("eins neun zwei punkt eins sechs acht punkt null punkt eins", "eins neun zwei punkt eins sechs acht punkt null punkt eins", "ip",
     "192.168.0.1"),
    ("ｘ ４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１", "card", "4111 1111 1111 1111"),
    ("Four triple one one one one one one one one one one one one one.", "Four triple one one one one one one one one one one one one one",
     "card", "4111111111111111"),
])
def test_disguises(text, piece, kind, value):
    base, found = pii.find(text)
    mine = [s for s in found if s.value == value]
    assert [(s.kind, text[s.start:s.end]) for s in mine] == [(kind, piece)] and not [s for s in base if s.value == value]
    assert piece not in pii.mask(text, found)


@pytest.mark.parametrize("text", [
    "We look at the house. Dot com was a word.", "meet us at noon (at home) [dot]", "un deux trois, soleil", "one of two, three of four",
    "the point of it at last point", "look at example.com", "1990–2000 and 1.5 × 10²", "Сообщение в 12 часов", "<at> <dot>", "1 point 5",
    "555-1595 Un deux"])
def test_plain_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_base_spans_stay_and_offsets_hold_in_mixed_texts():
    rng = random.Random(11)
    said = ["mаx [at] host [dot] org", "a1@b.co", "1 dot 2 dot 3 dot 4", "5.6.7.8", "+1 (607) 555-1595", "plus four nine three zero 1 2 3 4 5 6 7",
            "4111 1111 1111 1111", "４１１１-１１１１-１１１１-１１１１", "é​́", "word", "sept", "(x)", "日本"]
    want = {"mаx [at] host [dot] org": "max@host.org", "1 dot 2 dot 3 dot 4": "1.2.3.4", "４１１１-１１１１-１１１１-１１１１": "4111-1111-1111-1111",
            "plus four nine three zero 1 2 3 4 5 6 7": "+4930" + "1 2 3 4 5 6 7"}
    for _ in range(400):
        parts = [rng.choice(said) for _ in range(rng.randrange(1, 9))]
        text = " ;; ".join(parts)
        base, found = pii.find(text)
        assert spans(base) == naive(text) and set(base) <= set(found)
        assert sorted(s.value for s in found if s not in base) == sorted(want[p] for p in parts if p in want)
        assert all(text[s.start:s.end] in parts for s in found)


def test_edits_map_back():
    t = pii.apply("abcdefgh", [(1, 3, ""), (4, 5, "XYZ"), (5, 5, "."), (6, 8, "!")])
    assert t.text == "adXYZ.f!" and t.back(0, 1) == (0, 1) and t.back(1, 2) == (3, 4) and t.back(2, 4) == (4, 5)
    assert t.back(1, 8) == (3, 8) and t.back(0, 2) == (0, 4)


def test_linear_in_long_runs():
    long = 100_000
    t0 = time.perf_counter()
    for text in ("a" * long, "1" * long, "1." * long, "@" * long, "a@" * long, "+1" + "(" * long, " " * long, "[ " * long, "one " * long, "1 " * long,
                 "a dot " * long, " at a dot" * long, "é" + "​" * long, "a at " * long, "double " * long, "@a." * long, "+1 " * long, "plus " * long):
        pii.find(text)
    assert time.perf_counter() - t0 < 60


def test_query_is_the_digest_of_the_operator(spark):
    docs = table(spark, SF001)
    got = {r.doc_id: r for r in op11_pii(spark, SF001).collect()}
    assert len(got) == docs.count() and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0
    for r in docs.collect():
        base = naive(r.text or "")
        listed = ",".join(":".join(map(str, s)) for s in base)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(g.spans.split(","))


def test_odd_and_empty_tables(spark):
    docs = odd(spark).withColumn("pii", docs_lit()).withColumn("base", docs_lit())
    out = pii.find_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and set(CLASHING) <= set(out.columns)
    assert [r.pii for r in out.collect() if not r.text] == [([], [])] * docs.where("coalesce(text, '') = ''").count()
    assert pii.find_documents(empty(spark)).count() == 0 and pii.mask_documents(empty(spark)).count() == 0
    masked = pii.mask_documents(docs)
    assert masked.where("text is null").count() == docs.where("text is null").count()


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("x")
