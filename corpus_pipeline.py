"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import mixing, packing, quality, secret_scan, simhash
from feedspark.llm.common import materialize, read_docs
from feedspark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id (of rows that share that id, one)."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    groups = simhash.near_duplicates(rows.select(F.struct("doc.doc_id", "row").alias("doc_id"), "doc.text"), width=4, k=4)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that the mix draws, a row each."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row per piece, with its ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Hash rotations, random draws and a tokenizer's vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = read_docs(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
