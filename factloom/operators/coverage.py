"""Submission channels: mentions with offsets, relation checks and the channel of a package."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import EDGE

from .pages import owning_core

#: Whole numbers up to this are exact in a double.
LARGEST = 2**53 - 1
# Fixed value: wording in a document that addresses a model rather than a reader; case does not matter, and lines do not end it.
INJECTION = r"\b(?:ignore|disregard|override|forget)\b.{0,80}\b(?:(?:prior|previous|earlier|above|all)\s+)?(?:instructions?|directions?|rules?|system|developer|prompt)\b|\bdo\s+not\s+(?:follow|obey)\b.{0,80}\b(?:instructions?|directions?|rules?|prompt)\b|\b(?:system|developer)\s+(?:message|prompt)\b|\b(?:browse|search)\s+(?:the\s+)?(?:web|internet)\b|\b(?:call|invoke|use)\s+(?:a\s+)?(?:tool|function)\b|\b(?:reveal|print|return|output)\b.{0,60}\b(?:hidden|system|developer)\s+(?:prompt|instructions?)\b"
# How each channel is mentioned, in order of precedence.
CHANNELS = {
    "email": r"\be-?mail(?:ed|ing|s)?\b|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "portal": r"\b(?:portal|canadabuys|buyandsell|epost|e-?procurement)\b",
    "electronic": r"\belectronic(?:ally)?\b",
    "fax": r"\b(?:fax|facsimile)(?:ed|ing|es)?\b",
    "postal_mail": r"\b(?:postal mail|registered mail|p\.?\s*o\.?\s*box)\b|(?<!e-)\bmail(?:ed|ing)?\b",
    "courier": r"\bcourier(?:ed|ing|s)?\b",
    "hand_delivery": r"\b(?:hand delivery|hand-deliver(?:ed|y)?|in person)\b",
}
#: A generic mention goes if a specific one starts at most so far behind its end.
GENERIC, GENERIC_REACH = "electronic", 12
LEAST_CONFIDENCE, LONGEST_QUOTE = 0.9, 500


def channel_mentions(text: str | None) -> list[tuple[str, int, int]]:
    """(channel, start, end) in code points, by place."""
    order = list(CHANNELS)
    found = sorted({(m.start(), m.end(), order.index(c)) for c, p in CHANNELS.items() for m in re.finditer(p, text or "", re.I | re.A)})
    generic = order.index(GENERIC)
    specific = [start for start, _, c in found if c != generic]
    return [(order[c], a, b) for a, b, c in found if c != generic or not any(a <= s <= b + GENERIC_REACH for s in specific)]


def mentions(pages: DataFrame, keys: tuple[str, ...] = ("document_sha256", "page"), text: str = "text") -> DataFrame:
    """All mentions of the pages with the ordinal of the core that owns each."""
    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*key, *m) for *key, t in frame.itertuples(index=False) for m in channel_mentions(t)]
            yield pd.DataFrame(rows, columns=[*keys, "channel", "start", "end"])

    found = pages.select(*keys, text).mapInPandas(find, f"{kept}, channel string, start int, `end` int")
    return found.withColumn("core", owning_core(F.col("start"), F.col("end")))


def checked_relations(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations of coverage units with the first reason that speaks against each, null if none does."""
    joined = relations.join(units.select("candidate_id", "core_start", "core_end", "source_start", "source_end"), "candidate_id")
    start, end = F.col("relation_start"), F.col("relation_end")
    middle = start + F.floor((end - start - 1) / 2)
    some = F.col("condition_start").isNotNull() | F.col("condition_end").isNotNull()
    whole = F.col("condition_start").isNotNull() & F.col("condition_end").isNotNull()
    inside = (F.col("condition_start") >= start) & (F.col("condition_end") <= end) & (F.col("condition_end") > F.col("condition_start"))
    reason = (
        F.when((start < F.col("source_start")) | (end > F.col("source_end")) | (end <= start), "offset_mismatch")
        .when(end - start > LONGEST_QUOTE, "quote_too_long")
        .when((middle < F.col("core_start")) | (middle >= F.col("core_end")), "ownership_mismatch")
        .when(F.col("confidence") < LEAST_CONFIDENCE, "low_confidence")
        .when(some & ~F.coalesce(whole & inside, F.lit(False)), "condition_mismatch")
        .when((F.col("subject_scope") == "ambiguous") | (F.col("modality") == "unknown") | ((F.col("subject_scope") == "whole_bid") & (F.col("channel") == "unspecified")), "semantic_uncertainty")
    )
    return joined.withColumn("reason", reason).drop("core_start", "core_end", "source_start", "source_end")


def resolve_channels(relations: DataFrame) -> DataFrame:
    """Per package: status (unique, multiple, contradicted, possible_only, none, unresolved) and the channel if unique.

    Every amendment that speaks of the whole bid has to repeat the base's channels as they are and require one.
    """
    bid = relations.filter("subject_scope = 'whole_bid'")
    positive = F.col("modality") != "prohibited"
    signature = F.concat_ws("|", "channel", "modality", F.coalesce("condition_sha256", F.lit("-")))
    versions = bid.groupBy("package_id", "role", F.coalesce("amendment_number", F.lit("")).alias("version")).agg(F.array_sort(F.collect_set(F.when(positive, signature))).alias("signatures"), F.bool_or(F.col("modality") == "required").alias("requires"))
    base = versions.filter("role = 'base'").groupBy("package_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("signatures")))).alias("of_base"))
    stray = (F.col("of_base").isNull() & (F.size("signatures") > 0)) | (F.col("of_base") != F.col("signatures")) | ~F.col("requires")
    weak = versions.filter((F.col("role") == "amendment") & (F.size("signatures") > 0)).join(base, "package_id", "left").groupBy("package_id").agg(F.bool_or(stray).alias("weak"))
    named = F.col("channel") != "unspecified"
    whole = F.col("subject_scope") == "whole_bid"
    sums = relations.groupBy("package_id").agg(
        F.array_sort(F.collect_set(F.when(whole & named & positive, F.col("channel")))).alias("possible"),
        F.collect_set(F.when(whole & named & (F.col("modality") == "required"), F.col("channel"))).alias("required"),
        F.collect_set(F.when(whole & named & ~positive & F.col("condition_sha256").isNull(), F.col("channel"))).alias("prohibited"),
        F.bool_or((F.col("subject_scope") == "ambiguous") | (F.col("modality") == "unknown") | (whole & ~named)).alias("unclear"),
    )
    only = F.try_element_at("possible", F.lit(1))
    status = (
        F.when(F.col("unclear") | F.coalesce("weak", F.lit(False)), "unresolved")
        .when(F.size("possible") == 0, "none")
        .when(F.size("possible") > 1, "multiple")
        .when(F.array_contains("prohibited", only), "contradicted")
        .when(~F.array_contains("required", only), "possible_only")
        .otherwise("unique")
    )
    return sums.join(weak, "package_id", "left").select("package_id", status.alias("status"), F.when(status == "unique", only).alias("channel"))


def sections(lines: DataFrame, document: str, order: str, heading: str) -> DataFrame:
    """Each line with the last heading at or before it."""
    carried = F.last(heading, ignorenulls=True).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", carried)


def injected(text: Column) -> Column:
    """Whether a text has wording that addresses a model; null has none."""
    return F.coalesce(text.rlike("(?is)" + INJECTION.replace(r"\b", EDGE)), F.lit(False))


def tainted_batches(texts: DataFrame, batch: str, text: str = "text") -> DataFrame:
    """Per batch its texts, how many of them address a model, and whether the batch is tainted: one taints it all."""
    return texts.groupBy(batch).agg(F.count("*").alias("texts"), F.count_if(injected(F.col(text))).alias("injected")).withColumn("tainted", F.col("injected") > 0)


def absolute_offsets(base: Column, start: Column, length: Column, condition_start: Column, condition_length: Column) -> Column:
    """A relation's offsets, and its condition's, in the source that begins at ``base``; the condition's count from the relation.

    Null for a relation that is empty or goes beyond the largest exact whole number; without a condition its offsets are null.
    """
    begin, end = base + start, base + start + length
    condition = begin + condition_start
    condition_end = condition + condition_length
    ends = F.greatest(end, condition_end)
    offsets = F.struct(begin.alias("start"), end.alias("end"), condition.alias("condition_start"), condition_end.alias("condition_end"))
    return F.when((length > 0) & (ends <= LARGEST), offsets)
