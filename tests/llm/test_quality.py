import re

from helpers import empty, odd, odd_rows, SF001, table, WORD

from feedspark.llm import quality as Q


def slow(text):
    text = text or ""
    words, where = WORD.findall(text), {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    rep = {i + k for w in where.values() if len(w) > 1 for i in w for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep),
            len(words) < 10 or 100 * len(rep) > 20 * len(words))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    extra = [(100 + i, t, "", "", 0) for i, t in enumerate(
        ["a b c d e " * 3, "a a a a a", "a a a a a a", "a " * 50, "x y\nx y\n\n \nx y", "#*$%&|<> " * 4, "a b c d e f a b c d e g b c d e f",
         " wide space stays " * 4, "\r\n".join(["one two three"] * 4), "1 2 3 4 5 6 7 8 9 1 2 3 4 5 1 2 3 4 5 6"])]
    rows = [(r.doc_id, r.text) for r in table(spark, SF001).collect()] + [r[:2] for r in odd_rows() + extra]
    df = table(spark, SF001).unionByName(spark.createDataFrame(odd_rows() + extra, "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted(str((r.doc_id, *(r[n] for n in NAMES))) for r in Q.judge(df).collect())
    assert got == sorted(str((d, *slow(t))) for d, t in rows)


def test_rules_judge_the_junk_and_keep_the_prose(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF001, "labels").collect()}
    got = [(labels[r.doc_id], r) for r in Q.judge(table(spark, SF001)).collect() if r.doc_id in labels]
    assert all(r.kept for y, r in got if y == 1 and not r.base_failed)
    assert sum(not r.kept for y, r in got if y == 0) >= 0.9 * sum(y == 0 for y, _ in got)


def test_every_rule_is_named_where_it_fails(spark):
    texts = {"mean_word_length": "the " + "x" * 500 + " and " * 2 + "a b c d e f g h i", "symbol_ratio": "the and #### of to ### in is a b c d e f",
             "stop_words": " ".join(f"q{i}x" for i in range(60)), "duplicate_lines": "the one two three a\n" * 1 + "of\n" * 7,
             "bullet_lines": "\n".join(f"- the {i} of it" for i in range(9)), "ellipsis_lines": "\n".join(f"the {i} of it..." for i in range(9)),
             "shouting": "THE AND OF TO IN IS ABOVE BELOW UNDER OVER BETWEEN"}
    df = spark.createDataFrame([(n, t) for n, t in texts.items()], "doc_id string, text string")
    for r in Q.judge(df).collect():
        assert r.doc_id in r.failed and not r.kept


def test_filter_keeps_rows_as_they_were(spark):
    df = odd(spark)
    out = Q.filter_documents(df)
    assert out.columns == df.columns
    kept = sorted(str(r.doc_id) for r in Q.judge(df).where("kept").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == kept and "3" not in kept and kept.count("2") == 2
    assert Q.filter_documents(empty(spark)).count() == 0


def test_plan_is_a_projection(spark):
    plan = Q.judge(table(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
