"""String helpers of the feed protocol, all as built-in (JVM) expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_spaces_tabs(c) -> Column:
    """Strip spaces at both ends, then tabs at both ends (spaces inside tabs stay)."""
    return F.trim(F.trim(_col(c), F.lit(" ")), F.lit("\t"))


def atoi(c) -> Column:
    """Leading integer after optional white space and sign, else 0 (bigint; 0 when out of range)."""
    digits = F.regexp_extract(_col(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def count_char(c, ch: str) -> Column:
    """Number of occurrences of one literal character."""
    return F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(ch), F.lit("")))


def split_fields(c, sep: str = C.FIELD_SEP) -> Column:
    """Tokens of a line the way a stream tokenizer reads them: a trailing empty token is not produced."""
    s = _col(c)
    body = F.when(s.endswith(sep), s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)
    pattern = "\\" + sep if sep in "^$.|?*+()[]{}\\" else sep
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(body, pattern, -1))


def refresh_seconds(c) -> Column:
    """Refresh interval from the server text: atoi, with 0 / INT_MAX / INT_MIN mapped to the fallback.

    A value that does not fit 32 bits is read the way a C ``int`` would not be
    able to: it is treated as unusable (fallback).
    """
    v = atoi(c)
    in_range = (v >= C.INT_MIN) & (v <= C.INT_MAX)
    bad = (~in_range) | v.isin(0, C.INT_MAX, C.INT_MIN)
    return F.when(bad, F.lit(C.REFRESH_FALLBACK_S)).otherwise(v).cast("int")


def key_valid(c) -> Column:
    """Key character class: letters, digits and '-' only."""
    return _col(c).rlike(C.KEY_CHARS_PATTERN)


def audit_time(c) -> Column:
    """Audit-line clock: day/month/2-digit year -> 12-hour time (session time zone)."""
    return F.date_format(_col(c), C.AUDIT_TIME_FORMAT)
