import re

from pyspark.sql import functions as F

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves: extra columns of the input must not disturb them.
CLASHING = ("shard", "slot", "size", "fp", "secrets", "row", "rank", "target", "taken", "score", "kept", "n_words", "grp", "pos")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, repeated rows, equal texts under different ids."""
    prose = "The quick brown fox and the lazy dog went to the river and then they slept in the shade of a tree."
    long = " ".join(f"word{i % 977}x{i % 31} the" for i in range(20000))
    rows = [(1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, None, "en", "b", None),
            (4, "", None, "b", 0), (5, " \t\n\x0b\x0c\r ", "en", None, 7), (None, prose, "en", None, 1), (None, None, None, None, None),
            (6, long, "en", "c", len(long)), (7, "\x85\xa0é É ß 漢字 😀 ﬁ", "xx", "é", 3), (8, "a", "en", "c", 1),
            (9, "one line\n\none line\none line\n" * 9, "en", "c", 5), (10, "token = \"abcdef123456\" " * 3, "en", "b", 1)]
    return rows


def odd(spark, clash=True):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
