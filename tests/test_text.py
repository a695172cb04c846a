from feedspark.functions.text import atoi, count_char, refresh_seconds, split_fields, trim_spaces_tabs


def test_atoi(spark):
    rows = [("12", 12), (" 12x", 12), ("-3", -3), ("x", 0), ("", 0), ("99999999999", 99999999999),
            ("+7", 7), ("99999999999999999999999", 0)]
    got = spark.createDataFrame(rows, "s string, want bigint").select("want", atoi("s").alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_refresh(spark):
    rows = [("0", 30), ("2147483647", 30), ("-2147483648", 30), ("7", 7), ("-5", -5), ("junk", 30),
            ("99999999999", 30)]
    got = spark.createDataFrame(rows, "s string, want int").select("want", refresh_seconds("s").alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_trim(spark):
    rows = [("  \tab c\t  ", "ab c"), ("\t a \t", " a "), ("   ", ""), ("\t\t", ""), ("x", "x")]
    got = spark.createDataFrame(rows, "s string, want string").select(
        "want", trim_spaces_tabs("s").alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_split_and_count(spark):
    rows = [("d^1^m", ["d", "1", "m"], 2), ("d^1^", ["d", "1"], 2), ("d^^m", ["d", "", "m"], 2),
            ("d^1^m^x", ["d", "1", "m", "x"], 3), ("", [], 0)]
    got = spark.createDataFrame(rows, "s string, want array<string>, n int").select(
        "want", "n", split_fields("s").alias("got"), count_char("s", "^").alias("c")).collect()
    assert all(r.got == r.want and r.c == r.n for r in got), got


def test_key_charset(spark):
    from feedspark.functions.text import key_valid

    rows = [("abc-DEF-123", True), ("", True), ("a b", False), ("k_1", False), ('{"k": 1}', False), ("ключ", False)]
    got = spark.createDataFrame(rows, "s string, want boolean").select("want", key_valid("s").alias("got")).collect()
    assert all(r.got == r.want for r in got), got
