"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in functions run: the words of a text are split once, bound to a
lambda variable, and every measure is an expression over that array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import WORD_SPACE, text_or_empty, word_array

# ---- fixed values (rule parameters) -------------------------------------------
SYMBOLS = "#*$%&|<>"
#: The commonest function words of four languages, lower case.
STOP_WORDS = (
    "the and of to in is that for it was with as be on by are this have from not at or an "
    "der die das und ist nicht ein eine zu den von mit auf des im sich dem als auch es "
    "le la les et un une de des est que dans pour en du qui pas sur au plus par il elle ce "
    "el los las y una que en por con para del se no su al lo como más o"
).split()
WINDOW = 5                                 # words in a repetition window
LEAST_WORDS = 10                           # base rule: fewer words fail
SHORT_TEXT = 50                            # too few words to miss stop words in: the ratio counts as 1
MOST_REPEATED_PCT = 20                     # base rule: more words in repeated windows fail
# ------------------------------------------------------------------------------


class Rule(NamedTuple):
    """``low <= measure <= high`` must hold (None: open)."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: The threshold table.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "mean_word_length", 2.0, 20.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.005, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    Rule("shouting", "upper_ratio", None, 0.8),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _grams(words: Column, n: int) -> Column:
    """XXH64 of every window of ``n`` words, in order (fewer words: none)."""
    last = F.size(words) - n
    return F.when(last < 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside an ``n``-word window that occurs twice or more in the text, each word once.

    Windows are sorted by (hash, position); one equal to a neighbour is a
    repeat.  Its words up to the start of the next repeat count, so the sum is
    the size of the union of all repeated windows.  Equality is that of 64-bit
    hashes inside one text.
    """
    def marked(sorted_grams: Column) -> Column:
        def at(i: Column) -> Column:
            here = F.get(sorted_grams, i)
            return F.when(
                (F.get(sorted_grams, i - 1)["h"] == here["h"]) | (F.get(sorted_grams, i + 1)["h"] == here["h"]), here["p"])

        return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(sorted_grams) - 1), at)))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(starts, i + 1) - p, F.lit(n)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x)

    def sorted_grams(grams: Column) -> Column:
        return F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def of(grams: Column) -> Column:
        # sorting and marking are needed only where two windows are equal
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(
            let(let(sorted_grams(grams), marked), covered))

    return let(_grams(words, n), of)


def measured(text: Column) -> Column:
    """All base counts and ratios of a text (not null) as one struct, everything computed once."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])

    def has_word(line: Column) -> Column:
        return F.length(F.translate(line, WORD_SPACE, "")) > 0

    def counts(b: Column) -> Column:
        words, lines = b["words"], b["lines"]
        n_lines = F.size(lines).cast("bigint")
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            n_lines.alias("n_lines"),
            (n_lines - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.array_contains(stop, F.lower(w)))).cast("bigint").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ")
                            | F.ltrim(x).startswith("•"))).cast("bigint").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint").alias(
                "n_ellipsis_lines"),
        )

    def ratios(r: Column) -> Column:
        c = r["c"]
        words, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
        return F.struct(
            *[c[n].alias(n) for n in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
                                      "n_bullet_lines", "n_ellipsis_lines")],
            *[r[n].alias(n) for n in ("word_chars", "n_symbols")],
            (r["word_chars"] / words).alias("mean_word_length"),
            (r["n_symbols"] / words).alias("symbol_ratio"),
            F.when(c["n_words"] < SHORT_TEXT, 1.0).otherwise(c["n_stop_words"] / words).alias("stop_word_ratio"),
            (c["n_dup_lines"] / lines).alias("dup_line_ratio"),
            (c["n_bullet_lines"] / lines).alias("bullet_line_ratio"),
            (c["n_ellipsis_lines"] / lines).alias("ellipsis_line_ratio"),
            (r["upper"] / F.greatest(r["upper"] + r["lower"], F.lit(1))).alias("upper_ratio"),
        )

    bound = F.struct(word_array(text).alias("words"), F.filter(F.split(text, "\n"), has_word).alias("lines"))
    raw = F.struct(
        let(bound, counts).alias("c"),
        F.length(F.translate(text, WORD_SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).alias("upper"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Ll}", ""))).alias("lower"),
    )
    return let(raw, ratios)


def failed_rules(measure: Callable[[str], Column], rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that are broken, compiled from the table into one array expression over ``measure(name)``."""
    def broken(r: Rule) -> Column:
        low = measure(r.measure) < r.low if r.low is not None else F.lit(False)
        high = measure(r.measure) > r.high if r.high is not None else F.lit(False)
        return F.when(low | high, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def base_failed(measure: Callable[[str], Column]) -> Column:
    return (measure("n_words") < LEAST_WORDS) | (100 * measure("n_repeat_words") > MOST_REPEATED_PCT * measure("n_words"))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measures, ``base_failed``, ``failed`` (rule names) and ``kept`` of every row.

    Null or empty texts have zero words and fail the base rule.  Repeated rows
    are judged each for itself; no row is dropped; an empty table gives no
    rows.  Only ``keep`` and ``text`` are read from ``docs``, so its other
    columns cannot clash; a column in ``keep`` must not bear a measure's name.
    """
    x = docs.select(*keep, measured(text_or_empty()).alias("_m")).select(*keep, "_m.*")
    x = x.withColumns({"base_failed": base_failed(F.col), "failed": failed_rules(F.col, rules)})
    return x.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were.

    The condition is one expression that measures a text once; a filter over
    ``judge`` would be pushed below its projection and measure it for every rule.
    """
    def keeps(m: Column) -> Column:
        return ~base_failed(m.getField) & (F.size(failed_rules(m.getField, rules)) == 0)

    return docs.where(let(measured(text_or_empty()), keeps))
