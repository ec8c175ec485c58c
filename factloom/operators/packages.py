"""Packages of documents: completeness, evaluation fields, readiness and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import B0, B1

# The states of a run, how far along each is, and where each may lead.
PROGRESS = {"queued": 0, "validating": 5, "staging": 12, "page_indexing": 24, "parsing": 38, "purging_source": 50, "extracting": 62, "reconciling": 76, "verifying": 88, "ready": 100, "partial": 100, "failed": 100, "cleanup_pending": 96, "expired": 100}
# The steps that a run may take from each state.
STEPS = {
    "queued": ("validating", "failed", "cleanup_pending", "expired"),
    "validating": ("staging", "failed", "cleanup_pending", "expired"),
    "staging": ("page_indexing", "failed", "cleanup_pending", "expired"),
    "page_indexing": ("parsing", "failed", "cleanup_pending", "expired"),
    "parsing": ("purging_source", "failed", "cleanup_pending", "expired"),
    "purging_source": ("extracting", "failed", "cleanup_pending", "expired"),
    "extracting": ("reconciling", "partial", "failed", "cleanup_pending", "expired"),
    "reconciling": ("verifying", "partial", "failed", "cleanup_pending", "expired"),
    "verifying": ("ready", "partial", "failed", "cleanup_pending", "expired"),
    "ready": ("cleanup_pending", "expired"),
    "partial": ("cleanup_pending", "expired"),
    "failed": ("cleanup_pending", "expired"),
    "cleanup_pending": ("failed", "expired"),
    "expired": (),
}
NEEDS_CLEANUP = ("ready", "partial")
MOST_DOCUMENTS, MOST_PAGES = 5, 300

EVALUATION_FIELDS = ("mandatory_gate", "rated_threshold", "technical_weight", "financial_weight", "selection_method")


def transitions() -> list[tuple[str, str]]:
    """All pairs of states that a run may go from and to."""
    return [(state, step) for state, steps in STEPS.items() for step in steps]


def valid_transition(old: Column, new: Column, cleaned: Column) -> Column:
    """Whether a run may go from one state to the other; staying is always allowed, results need a confirmed cleanup."""
    allowed = F.concat_ws(">", old, new).isin(*[f"{a}>{b}" for a, b in transitions()])
    return (old == new) | (allowed & (~new.isin(*NEEDS_CLEANUP) | cleaned))


def completeness(manifests: DataFrame) -> DataFrame:
    """Per package: unverified if it has one base, one solicitation number and amendments 1 to n once each, else incomplete.

    A label that is no number leaves the package incomplete.
    """
    amendment = F.when(F.col("role") == "amendment", F.col("amendment_number").try_cast("int"))
    sums = manifests.groupBy("package_id").agg(
        F.count_if(F.col("role") == "base").alias("bases"),
        F.count_if(F.col("solicitation_number").isNull()).alias("unnumbered"),
        F.count_distinct("solicitation_number").alias("numbers"),
        F.count_if(F.col("role") == "amendment").alias("amendments"),
        F.count_distinct(amendment).alias("distinct_amendments"),
        F.coalesce(F.min(amendment), F.lit(1)).alias("first"),
        F.coalesce(F.max(amendment), F.lit(0)).alias("last"),
    )
    contiguous = (F.col("amendments") == F.col("distinct_amendments")) & (F.col("first") == 1) & (F.col("last") == F.col("amendments"))
    whole = (F.col("bases") == 1) & (F.col("unnumbered") == 0) & (F.col("numbers") == 1) & contiguous
    return sums.select("package_id", F.when(whole, "unverified").otherwise("incomplete").alias("completeness"))


def requests(documents: DataFrame) -> DataFrame:
    """Per package of a request (role, pages): documents, bases, pages and the first rule that it breaks as ``reason``, or null."""
    sums = documents.groupBy("package_id").agg(F.count("*").alias("documents"), F.count_if(F.col("role") == "base").alias("bases"), F.sum("pages").alias("pages"))
    reason = F.when(F.col("documents") > MOST_DOCUMENTS, "too_many_documents").when(F.col("bases") != 1, "not_one_base").when(F.col("pages") > MOST_PAGES, "too_many_pages")
    return sums.withColumn("reason", reason)


def weight_of(label: str, col: Column) -> Column:
    """The percentages that stand with a label of weights and with no other label between."""
    other = "financial|price" if label == "technical" else "technical"
    mine = "technical" if label == "technical" else "financial|price"
    apart = rf"(?:(?!{B0}(?:{other}){B1})[^.;\n])"
    after = F.regexp_extract_all(F.lower(col), F.lit(rf"{B0}(?:{mine}){B1}{apart}{{0,60}}?(\d+(?:\.\d+)?)\s*(?:%|per\s*cent|percent)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(after, lambda x: x.cast("double")), lambda x: x <= 100))


def threshold(col: Column) -> Column:
    """A least score and its scale, from ``a/b``, ``a out of b`` or a single number."""
    number = r"(?<![\d.])(\d+(?:\.\d+)?)"
    pattern = number + r"\s*(?:/|out of)\s*(\d+(?:\.\d+)?)(?![\d.])"
    numbers, both = F.regexp_extract_all(F.lower(col), F.lit(number + r"(?![\d.])"), F.lit(1)), F.regexp_extract(F.lower(col), pattern, 1)
    least = F.when(both != "", both).when(F.size(numbers) == 1, F.element_at(numbers, 1))
    return F.struct(least.cast("double").alias("least"), F.nullif(F.regexp_extract(F.lower(col), pattern, 2), F.lit("")).cast("double").alias("scale"))


def evaluation_fields(rules: DataFrame) -> DataFrame:
    """Per package a column for each evaluation field: its value if all active rules agree on one, else null."""
    value = lambda f: F.when(F.col("field") == f, F.col("value"))
    one = lambda f: F.when(F.count_distinct(value(f)) == 1, F.max(value(f))).alias(f)
    return rules.filter("status = 'active'").groupBy("package_id").agg(*map(one, EVALUATION_FIELDS))


def readiness(requirements: Column, fields: Column, unknowns: Column) -> Column:
    return F.when((requirements == 0) | (fields == 0), "incomplete").when(unknowns > 0, "needs_clarification").otherwise("ready")
