"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted, by a hash and
then their bytes, and their ranks are their names; then adjacent names are paired, the distinct pairs are sorted
and named by rank in turn, and so on until one name is left for each document. So equal tables get equal names,
however they are partitioned. Two texts are equal exactly if they have as many blocks and the same last name. The
64-bit hash only carries blocks to their names: where distinct blocks share a hash, they are told apart by their
bytes.

Defined cases: null counts as empty, and empty texts are equal to each other. Null ids sort before all
others. Rows that repeat an id are told apart by the digest of their text; of rows that repeat both, one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage

BLOCK_BYTES = 4096
KEY = ("doc_id", "text_sha256", "n_blocks")


def _normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _blocks(docs: DataFrame, text: str, block_bytes: int, hash_bits: int) -> DataFrame:
    """doc_id, text_sha256, n_blocks, at, block and its hash; one row per block."""
    whole = docs.select("doc_id", _normalised(F.col(text)).alias("_text")).select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.col("_text").cast("binary").alias("_bytes"))
    counted = whole.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block_bytes)).cast("long"))
    cut = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("at"))
    block = F.substring("_bytes", (F.col("at") * block_bytes + 1).cast("int"), F.lit(block_bytes))
    return cut.select(*KEY, "at", block.alias("block")).withColumn("h", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits))


def _ranked(distinct: DataFrame, ranges: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with their rank as ``name``: sorted in ranges, counted within each, and added to the rows of the ranges before."""
    sorted_ = stage(distinct.repartitionByRange(*ranges).sortWithinPartitions(*order).select(*ranges, F.monotonically_increasing_id().alias("_at")), label)
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # one row per range
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return sorted_.join(F.broadcast(before), part == F.col("_part")).select(*ranges, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("name"))


def _first_names(docs: DataFrame, text: str, block_bytes: int, hash_bits: int) -> DataFrame:
    """The blocks' places with their names; copies counts rows that repeat both id and text."""
    blocks = _blocks(docs, text, block_bytes, hash_bits)
    places = stage(blocks.groupBy(*KEY, "at", "h").agg(F.count("*").alias("copies")), "places")
    names = _ranked(blocks.select("h", "block").distinct(), ["h"], ["h", "block"], "names")
    clashes = stage(names.groupBy("h").count().filter("count > 1").select("h"), "clashes")
    if clashes.isEmpty():
        return places.join(names, "h").select(*KEY, "at", "copies", "name")
    # Any fixed match between the names and the distinct blocks of one hash will do: both are taken in order.
    told_apart = blocks.join(clashes, "h", "left_semi")
    order = told_apart.select("h", "block").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("block")))
    exact = told_apart.join(order, ["h", "block"]).groupBy(*KEY, "at", "h", "r").agg(F.count("*").alias("copies"))
    placed = places.join(clashes, "h", "left_anti").withColumn("r", F.lit(1)).unionByName(exact)
    ranked = stage(names.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("name"))), "ranked")
    return placed.join(ranked, ["h", "r"]).select(*KEY, "at", "copies", "name")


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, n_blocks, copies and name: (n_blocks, name) is the text's identity."""
    current = stage(_first_names(docs, text, block_bytes, hash_bits), "level")
    longest, span = current.agg(F.max("n_blocks")).first()[0] or 1, 1
    done = current.filter(F.col("n_blocks") <= span)
    while span < longest:
        open_ = current.filter(F.col("n_blocks") > span)
        even = F.col("at") % 2 == 0
        pairs = open_.groupBy(*KEY, F.floor(F.col("at") / 2).alias("at")).agg(F.max("copies").alias("copies"), F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        names = _ranked(pairs.select("left", "right").distinct(), ["left", "right"], ["left", "right"], "pairs")
        current = stage(pairs.join(names, ["left", "right"]).select(*KEY, "at", "copies", "name"), "level")
        span *= 2
        done = done.unionByName(current.filter(F.col("n_blocks") <= span))
    return done.drop("at")


def deduplicate(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256."""
    named = identities(docs, text, block_bytes, hash_bits)
    # Written first, so that the join reads both sides as they are dealt and a large group can be split.
    groups = stage(named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    rows = named.join(groups, ["n_blocks", "name"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    stay = deduplicate(docs, text).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "group_size")
    keyed = docs.select(F.struct("*").alias("_doc"), "doc_id", F.sha2(_normalised(F.col(text)), 256).alias("_digest"))
    joined = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["_digest"] == stay["_sha"]))
    alone, copied = joined.filter("group_size = 1"), joined.filter("group_size > 1").dropDuplicates(["_id", "_sha"])
    return alone.unionByName(copied).select("_doc.*")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""
