"""The registered queries of the text operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import (
    ann, lm, mixing, packing, pii, prefix_trie, quality, secret_scan, sharding, simhash, token_counts, toxicity, whitening,
)
from feedspark.llm.common import id_fold, read_docs


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _span_digest(found: DataFrame, col: str, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base spans by kind, their list's hash, and the list of all spans."""
    def listed(spans: str):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    def n(kind: str):
        return F.size(F.filter(f"{col}.base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in kinds], F.sha2(listed(f"{col}.base").cast("binary"), 256).alias("base_sha256"),
                        listed(f"{col}.spans").alias("spans"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = dict.fromkeys(range(8), 1.0)
    return sharding.shard_documents(read_docs(spark, sf_dir), eight, {**eight, 8: 1.0})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_docs(spark, sf_dir), width=4, k=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_docs(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lm.score_documents(read_docs(spark, sf_dir), id_fold("doc_id") == 1)
    # sums of logarithms, comparable across engines to six places
    return x.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secret_scan.scan_documents(read_docs(spark, sf_dir).select("doc_id", "text"))
    return _span_digest(x, "secrets", secret_scan.KINDS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.document_sizes(read_docs(spark, sf_dir))).per_document()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality.judge(read_docs(spark, sf_dir))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pii.find_documents(read_docs(spark, sf_dir).select("doc_id", "text"))
    return _span_digest(x, "pii", pii.KINDS)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(read_docs(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.whiten(read_docs(spark, sf_dir, "embeddings"))
    return x.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_simhash, op3_nearest, op4_lm_scores, op5_secrets, op6_token_counts, op7_mixing, op8_toxicity,
           op9_quality, op10_packing, op11_pii, op12_prefix_trie, op13_whitening, pipeline)
    return {f.__name__: f for f in ops}
