"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_anchors, block_naming, bpe_reuse, host_quality, lattice_lm, lexical_search, pii, quality_classifier, repeated_passages, simhash, source_mix, token_files, vector_codes
from .common import documents

RULE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_kept", "kept")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(documents(spark, sf_dir)).select(*RULE_COLUMNS, F.round("host_failure_rate", 6).alias("host_failure_rate"))


def op2_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.token_digests(documents(spark, sf_dir))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.deduplicate(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["pass"], d["words"])), ",")
    return source_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", drawn.alias("draws"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.repeat_digests(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.repeat_digests(documents(spark, sf_dir)).drop("n_spans")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_host_quality, op2_bpe_reuse, op3_block_naming, op4_simhash, op5_quality_classifier, op6_lattice_lm, op7_source_mix, op8_token_files, op9_repeated_passages, op10_pii, op11_vector_codes, op12_block_anchors, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_host_quality": host_quality.ORACLE_SQL,
        "op3_block_naming": block_naming.ORACLE_SQL,
        "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_block_anchors": block_anchors.ORACLE_SQL,
        "op13_lexical_search": lexical_search.ORACLE_SQL,
    }
