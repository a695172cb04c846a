import time
import zlib

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, SF001, SF01, table
from pyspark.sql import functions as F

from feedspark.llm import toxicity as X


@pytest.fixture(scope="module")
def channel(spark):
    words = "idiot idiots stupid loser pathetic the and then river house book summer letter moon good ball".split()
    docs = spark.createDataFrame([(" ".join(words * 30),)], "text string")
    return X.Channel(X.character_model(docs))


def test_trigrams_sum_to_one(channel):
    p = np.exp(channel.logp.astype(np.float64))
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


@pytest.mark.parametrize("token,word", [
    ("1d10t", "idiot"), ("idi0t", "idiot"), ("i.d.i.o.t", "idiot"), ("i-d-i-o-t", "idiot"), ("iiidiooot", "idiot"), ("$tup1d", "stupid"),
    ("l0$3r", "loser"), ("p@th3t1c", "pathetic"), ("good", "good"), ("summer", "summer"), ("baaaall", "ball"), ("1diot", "idiot"), ("ba11", "ball"), ("g00d", "good"), ("idiot.", "idiot"), ("(idiot)!!", "idiot")])
def test_restores_disguised_words(channel, token, word):
    assert word in channel.words(token)


def test_restores_spaced_words(channel):
    assert channel.spaced("you i d i o t there") == ["idiot"] and channel.spaced("a b") == []
    assert channel.spaced("a a a a a a") == []


@pytest.mark.parametrize("token", ["i", "1", "!!!", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "42@mail8.example", "　", "%%%", "é" * 5000])
def test_any_token_is_taken(channel, token):
    channel.words(token)


def test_viterbi_finds_the_best_path(channel):
    """Against every path through small lattices."""
    def every(options):
        paths = [("", 0.0)]
        for own in options:
            paths = [(w + letters, p + price) for w, p in paths for letters, price in own]
        return paths

    def value(word, price):
        a = b = 0
        for c in word:
            k = 0 if c == " " else X._CODE.get(c, 1)
            price += float(channel.logp[a, b, k])
            a, b = (0, 0) if c == " " else (b, k)
        return price + float(channel.logp[a, b, 0])

    for token in ("1d10t", "l0$3rr", "a.b.c", "i d i", "$$|!", "oooo1"):
        paths = every(channel.lattice(token))
        best = max(value(w, p) for w, p in paths)
        assert abs(max(value(w, p) for w, p in paths if w == channel.restore(token)) - best) < 1e-6


def test_held_out_accuracy_and_planted_disguises(spark):
    docs, labels = table(spark, SF01), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in X.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r.toxic, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8 and np.mean([s >= 0.5 for s in neg]) < 0.05
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    model = X.train(docs.select("doc_id", "text"), labels, F.col("doc_id") % 5 != 0)
    prose = next(r.text for r in docs.where("lang = 'en' and n_chars between 900 and 1500").join(labels.where("toxic = 0 and quality = 1"), "doc_id").collect())
    insults = ["loser", "idiot", "moron"]
    forms = [prose, prose + " " + " ".join(insults), prose + " l0ser 1diot m0r0n", prose + " l o s e r you i d i o t and m o r o n", prose + " loooser iiidiot morrron"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(forms)], "doc_id long, text string")
    s = [r.s for r in df.select("doc_id", model.score(df).alias("s")).orderBy("doc_id").collect()]
    assert s[0] < 0.3 and all(x > s[0] + 0.2 for x in s[1:])


def test_odd_rows_and_missing_labels(spark):
    df = odd(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.score_documents(df, none).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (4, None), (10, 1), (9, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    assert all(0 <= r.score <= 1 for r in X.score_documents(df, one).collect())
    assert X.score_documents(empty(spark), one).count() == 0


def test_score_depends_on_the_text_alone(spark):
    docs, labels = table(spark, SF001), table(spark, SF001, "labels")
    twice = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.lit("zz"), "source": F.lit(None).cast("string")}))
    got = {r.doc_id: r.score for r in X.score_documents(twice, labels).collect()}
    assert all(got[d] == got[d + 1_000_000] for d in got if d < 1_000_000)


@pytest.mark.parametrize("token,word", [
    ("1d1075", "idiots"), ("5tup1d", "stupid"), ("10$3r", "loser"), ("i__d__i__o__t", "idiot"), ("i--d--i--o--t", "idiot"), ("iidiiott", "idiot"),
    ("l0ooooooosssssssssseeeeeeerrrr", "loser"), ("p-a-t-h-e-t-i-c-p-a-t-h-e-t-i-c", "patheticpathetic"), ("i/d/i/o/t", "idiot"),
    ("i,d,i,o,t", "idiot"), ("st#upid", "stupid"), ("$$$tupid", "stupid"), ("m00n", "moon"), ("letter", "letter")])
def test_restores_disguises_of_any_shape(channel, token, word):
    assert word in channel.words(token)


def test_long_tokens_are_decoded_in_time(channel):
    began = time.time()
    assert len(channel.words("1d10t/" * 20000)[-1]) >= 100000
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def short(spark):
    words = "ass tit boob poop idiot loser the and then river house book summer letter moon good ball".split()
    docs = spark.createDataFrame([(" ".join(words * 30),)], "text string")
    return X.Channel(X.character_model(docs))


@pytest.mark.parametrize("text,words", [
    ("you a s s there", ["ass"]), ("t i t", ["tit"]), ("b o o b", ["boob"]), ("p o o p", ["poop"]), ("a  s  s", ["ass"]), ("t\ti\tt", ["tit"]),
    ("the\np\no\no\np\nthe", ["poop"]), ("i  d  i  o  t", ["idiot"]), ("i d\ti\no   t", ["idiot"]), ("s s s s", []), ("a s", [])])
def test_restores_spaced_words_of_few_letters(short, text, words):
    assert short.spaced(text) == words
    assert [w for w in sum((found.list() for _, _, found, _ in X.Reader(short.logp)([text])), []) if len(w) > 2 and w in words] == words


def test_reader_gives_the_words_of_every_distinct_token(short):
    texts = ["Summer, summer. idiooot!! b00b a s s you", "", "漢字 ＡＢ x#y 4$$ ß ÿÿ éé\u00a0z \x85q", "the the", " \n\t ", "b  o  o  b"]
    rows = {}
    for text, unit, words, owner in X.Reader(short.logp)(texts):
        by = {}
        for w, o in zip(words.list(), owner.tolist()):
            by.setdefault(o, set()).add(w)
        for t, u in zip(text.tolist(), unit.tolist()):
            rows.setdefault(t, []).append(frozenset(by.get(u, ())))
    for i, text in enumerate(texts):
        low = text.lower()
        for mark in (", ", ". ", ".\n"):
            low = low.replace(mark, " ")
        want = [frozenset(short.words(t)) for t in set(low.split())] + [frozenset([w]) for w in dict.fromkeys(short.spaced(low))]
        assert sorted(map(sorted, filter(None, rows.get(i, [])))) == sorted(map(sorted, filter(None, want)))


def test_strengths_and_feature_sets(short):
    texts = ["summer loser", "", "loser loser idiot ass ball moon", "x"]
    reader = X.Reader(short.logp)
    sets = X.feature_sets(reader, texts)
    assert [len(f) == len(set(f.tolist())) for f in sets] == [True] * 4 and len(sets[1]) == 0
    table = np.zeros(X.FEATURES, np.float32)
    place = lambda w: X.features(X.Strings.of([w]))[0]
    for w, v in (("loser", 3.0), ("idiot", 2.0), ("ass", 1.0), ("ball", 0.5)):
        table[place(w)[0]] = v
        assert set(place(w)[place(w) >= 0].tolist()) <= set(sets[2].tolist())
    assert X.strengths(reader, table, texts).tolist() == [[3, 0, 0], [0, 0, 0], [3, 2, 1], [0, 0, 0]]
    assert (place("loser")[1:] == place("losers")[1:]).sum() == 3 and place("ab")[1:].tolist() == [-1] * 4


@pytest.mark.parametrize("gap", ["  ", "\n", "\t"])
def test_wide_gaps_part_spaced_words(short, gap):
    assert {"idiot", "loser"} <= set(short.spaced(f"i d i o t{gap}l o s e r"))


def test_logistic_sample_takes_copies_one_by_one(spark, monkeypatch):
    """A third of the labelled rows are copies of one text, the only toxic one."""
    rows = [(i, "some copied idiot words" if i % 3 == 0 else f"clean words number {i} and w{i * i}", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    drawn = []
    fit = X._fit
    monkeypatch.setattr(X, "FIT_ROWS", 60)
    monkeypatch.setattr(X, "_fit", lambda x, y: drawn.append(y) or fit(x, y))
    X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert 40 <= len(drawn[0]) <= 60 and 0.15 < drawn[0].mean() < 0.55


ALPHABET_PARTS = ["a", "aa", "aaa", "l", "ss", "é", "o", "t", ".", "--", "_", "#", "%%%", "'", "i", "d"]


def test_joint_viterbi_equals_restore(channel):
    import random

    rng = random.Random(9)
    tokens = ["".join(rng.choice(ALPHABET_PARTS) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "!", "!!", "$$$", "1", "00", "(", "@"])
              for _ in range(3000)]
    tokens += ["idiot", "summer", "ß", "...", "漢字", "l0l", "ª", "1", "!!!"]
    got = channel.restore_all(tokens)
    assert {t: channel.restore(t) for t in tokens} == got
    assert channel.words_of(tokens) == [channel.words(t) for t in tokens]


@pytest.mark.parametrize("token,word", [("4$$", "ass"), ("$417", "salt"), ("80085", "boobs")])
def test_digits_and_symbols_alone_are_decoded(spark, token, word):
    words = "ass salt boobs bass sat boss alt the and".split()
    model = X.Channel(X.character_model(spark.createDataFrame([(" ".join(words * 30),)], "text string")))
    assert word in model.words(token)


def test_trigrams_are_those_of_the_words(spark):
    text = "The cat's cat, wor1d DON'T don «Été» x_y _ab_ 漢字 (cat)!! a　b \x85c ªb ÿ .x. é"
    words = [w.strip(X._TRIM) for w in text.lower().split()]
    want = {}
    for w in filter(str.isalpha, words):
        code = [0, 0, *[X._CODE.get(c, 1) for c in w], 0]
        for k in range(len(w) + 1):
            g = (code[k] * X.BASE + code[k + 1]) * X.BASE + code[k + 2]
            want[g] = want.get(g, 0) + 1
    total = np.zeros(X.BASE ** 3, np.int64)
    X.add_trigrams(total, text)
    assert {int(g): int(total[g]) for g in np.flatnonzero(total)} == want
    X.add_trigrams(total, "")
    assert int(total.sum()) == sum(want.values())
