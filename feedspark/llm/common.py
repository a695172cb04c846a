"""Shared pieces of the text operators: word and split definitions, scratch tables, table sizes."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.session import materialize

# ---- fixed values (definitions shared by all operators) ----------------------
WORD_SPACE = " \t\n\x0b\x0c\r"            # what separates words; everything else belongs to a word
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
# ------------------------------------------------------------------------------


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text as an array (no empty strings)."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: word starts are non-space characters after a space or the start."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def id_fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


@F.pandas_udf(T.BinaryType())
def zipped(texts: pd.Series) -> pd.Series:
    """Texts in UTF-8, each compressed by itself, for a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([pack(t.encode("utf-8")) for t in texts], dtype=object)


def part_count(total: int | None, per_part: int, least: int = 1) -> int:
    """Number of parts of about ``per_part`` units for ``total`` units."""
    return max(least, -(-int(total or 0) // per_part))


__all__ = [
    "SPACE_RUN", "WORD_SPACE", "id_fold", "materialize", "part_count", "read_docs", "text_or_empty", "utf8_bytes",
    "word_array", "word_count", "zipped",
]
