"""Input tables with explicit schemas, and rows that do not qualify set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import nfkc, trimmed

PAGES = "document_sha256 string, page int, text string"
CANDIDATES = "candidate_id string, document_sha256 string, evidence_quote string"
FACTS = "package_id string, id string, topic string, fact_key string, value string, document_sha256 string, document_role string, amendment_number string, effect string, verified boolean"
COST_EVENTS = "run_id string, seq int, attempt_id string, provider string, operation string, status string, actual_micro_usd bigint, estimated_micro_usd bigint, latency_ms bigint"

LEAST_BYTES, MOST_BYTES = 1, 25 * 1024 * 1024
MOST_NAME = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as packages of one page each."""
    return docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("document_sha256"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def staged_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows, each with the reason for which it is set apart, or null."""
    files = spark.read.format("binaryFile").load(path)
    size = F.length("content")
    return files.withColumn("reason", F.when(~size.between(LEAST_BYTES, MOST_BYTES), "size").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "signature"))


def checked_name(col: F.Column) -> F.Column:
    """A file name in composed form without control characters, or null if it is not the name of a PDF."""
    name = trimmed(F.regexp_replace(nfkc(col), r"[\x00-\x1F\x7F]", ""))
    return F.when(F.length(name).between(1, MOST_NAME) & name.rlike(r"(?i).\.pdf$") & ~name.rlike(r"[/\\]"), name)


def unique_json_string(payload: F.Column, *paths: str) -> F.Column:
    """The one non-empty string that the given JSON paths have in common; null if there is none or they differ."""
    found = F.array_distinct(F.filter(F.array(*[F.get_json_object(payload, p) for p in paths]), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.when(F.size(found) == 1, F.element_at(found, 1))
