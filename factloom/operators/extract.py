"""The deterministic extractor: a scope claim per document and its mandatory sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import B0, B1, sentences

PER_CHUNK, PER_DOCUMENT = 3, 8
MANDATORY = rf"(?i){B0}(?:must|shall|required){B1}"


def scope_claims(chunks: DataFrame, document: str = "document_sha256") -> DataFrame:
    """The first sentence of each document: document, ordinal of the chunk, quote. Documents without a sentence are left out."""
    first = chunks.select(document, "ordinal", F.try_element_at(sentences(F.col("text")), F.lit(1)).alias("quote")).filter("quote IS NOT NULL")
    return first.groupBy(document).agg(F.min("ordinal").alias("ordinal"), F.min_by("quote", "ordinal").alias("quote"))


def mandatory_requirements(chunks: DataFrame, document: str = "document_sha256") -> DataFrame:
    """Mandatory sentences, three of a chunk and eight of a document at most: document, n, ordinal, quote."""
    binding = F.slice(F.filter(sentences(F.col("text")), lambda s: s.rlike(MANDATORY)), 1, PER_CHUNK)
    each = chunks.select(document, "ordinal", F.posexplode(binding).alias("at", "quote"))
    numbered = each.withColumn("n", F.row_number().over(Window.partitionBy(document).orderBy("ordinal", "at")))
    return numbered.filter(F.col("n") <= PER_DOCUMENT).select(document, "n", "ordinal", "quote")
