"""Which drafted records may be published: each is bound to places in the source, and these to verified channel relations.

Records have package_id, batch_id, kind, ordinal (their place in the batch), record_id, document_sha256 and tainted;
annotations say whether a record speaks of submission (relevance s), does not (n) or may (u); citations have an
ordinal of their own, ``citation``, and a quote, and bindings say where on which page each stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["package_id", "batch_id", "kind", "ordinal"]
CITATION = [*RECORD, "citation"]
MERGED = ["package_id", "kind", "record_id"]
# How well a record is bound to its source, best first, and the most citations of a record.
BINDINGS = ("exact_bound", "unlocated", "coverage_gap", "relation_gap", "relation_conflict")
MOST_CITATIONS = 3


def placed_citations(citations: DataFrame, bindings: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations with page, start and end, and ``bound``: one binding only, whose place on its page reads as the quote does."""
    of_each = bindings.groupBy(CITATION).agg(F.count("*").alias("_bindings"), *[F.max(c).alias(n) for c, n in (("document_sha256", "_document"), ("page", "page"), ("start", "start"), ("end", "end"))])
    texts = pages.select(F.col("document_sha256").alias("_document"), "page", F.col("text").alias("_text"))
    joined = citations.join(of_each, CITATION, "left").join(texts, ["_document", "page"], "left")
    reads = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("evidence_quote")
    sound = (F.col("_bindings") == 1) & (F.col("_document") == F.col("document_sha256")) & (F.col("end") > F.col("start")) & reads
    return joined.withColumn("bound", F.coalesce(sound, F.lit(False))).select(*citations.columns, "page", "start", "end", "bound")


def crossed_relations(placed: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """Per bound citation: whether a verified unit owns its place, and what the unit's relations that overlap it say.

    ``units`` are the verified ones (candidate_id, document_sha256, page, core and source spans), ``relations`` theirs.
    """
    start, end = F.col("start"), F.col("end")
    middle = start + F.floor((end - start - 1) / 2)
    inside = (middle >= F.col("core_start")) & (middle < F.col("core_end")) & (start >= F.col("source_start")) & (end <= F.col("source_end"))
    spans = units.dropDuplicates(["candidate_id"]).select("candidate_id", "document_sha256", "page", "core_start", "core_end", "source_start", "source_end")
    owned = placed.filter("bound").join(spans, ["document_sha256", "page"]).filter(inside).select(*CITATION, "start", "end", "candidate_id")
    said = relations.select("candidate_id", "relation_start", "relation_end", "subject_scope", "modality", "channel")
    met = owned.join(said, "candidate_id", "left")
    over = F.coalesce((F.col("relation_start") < F.col("end")) & (F.col("relation_end") > F.col("start")), F.lit(False))
    scope, named = F.col("subject_scope"), F.col("channel") != "unspecified"
    whole = over & (scope == "whole_bid") & named
    any_ = lambda test, name: F.bool_or(test).alias(name)
    return met.groupBy(CITATION).agg(
        F.lit(True).alias("covered"), any_(over, "overlaps"), any_(whole & (F.col("modality") != "unknown"), "compatible"),
        any_(over & ((scope == "ambiguous") | (F.col("modality") == "unknown") | ~named), "unclear"), any_(over & named & scope.isin("whole_bid", "ambiguous"), "channelled"),
        F.collect_set(F.when(whole, F.col("channel"))).alias("channels"),
    )


def _citation_outcome(relevance: Column) -> Column:
    """(reason, source_binding, disagrees) of a citation; no reason if it stands."""
    of = lambda reason, binding, disagrees: F.struct(F.lit(reason).alias("reason"), F.lit(binding).alias("source_binding"), (disagrees if isinstance(disagrees, Column) else F.lit(disagrees)).alias("disagrees"))
    submission = relevance == "s"
    return (
        F.when(F.col("cited") != F.col("document_sha256"), of("cross_document_citation", "unlocated", False))
        .when(~F.col("bound"), of("invalid_private_source_binding", "unlocated", False))
        .when(F.col("covered").isNull(), of("incomplete_occurrence_coverage", "coverage_gap", submission))
        .when(submission & ~F.col("overlaps"), of("relationless_submission_record", "relation_gap", True))
        .when(submission & (~F.col("compatible") | F.col("unclear")), of("submission_relation_conflict", "relation_conflict", True))
        .when((relevance == "n") & F.col("channelled"), of("non_submission_relation_overlap", "relation_conflict", True))
        .when(relevance == "u", of("semantic_uncertainty", "exact_bound", True))
        .otherwise(of(None, "exact_bound", False))
    )


def origin_records(records: DataFrame, annotations: DataFrame, citations: DataFrame, bindings: DataFrame, pages: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """Each drafted record with relevance, reason, source_binding, semantic_crosscheck, publication and whole-bid channels.

    The first citation that does not stand decides.
    """
    placed = placed_citations(citations, bindings, pages)
    crossed = placed.join(crossed_relations(placed, units, relations), CITATION, "left").withColumnRenamed("document_sha256", "cited")
    told = annotations.groupBy(RECORD).agg(F.count("*").alias("_annotations"), F.max("relevance").alias("_relevance"))
    relevance = F.when(F.col("_annotations") == 1, F.col("_relevance"))
    marked = records.join(told, RECORD, "left").withColumn("relevance", relevance).drop("_relevance")
    outcomes = marked.select(*RECORD, "document_sha256", "relevance").join(crossed, RECORD).withColumn("_outcome", _citation_outcome(F.col("relevance")))
    failed = F.col("_outcome")["reason"].isNotNull()
    summed = outcomes.groupBy(RECORD).agg(F.count("*").alias("_citations"), F.min_by("_outcome", F.when(failed, F.col("citation"))).alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("_channels"))
    joined = marked.join(summed, RECORD, "left")
    before = (
        F.when(F.col("_annotations").isNull(), "missing_annotation")
        .when(F.col("_annotations") > 1, "duplicate_annotation")
        .when(F.col("tainted"), "prompt_injection")
        .when(F.col("_citations") > MOST_CITATIONS, "record_citation_capacity")
        .when(F.col("_citations").isNull(), "missing_exact_citation")
    )
    first = F.col("_first")
    reason = F.coalesce(before, first["reason"])
    binding = F.when(before.isNotNull(), "unlocated").otherwise(F.coalesce(first["source_binding"], F.lit("exact_bound")))
    crosscheck = F.when(reason.isNull(), "consistent").when(before.isNull() & first["disagrees"], "disagrees").otherwise("unknown")
    channels = F.when(before.isNull(), F.col("_channels")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        *records.columns, "relevance", reason.alias("reason"), binding.alias("source_binding"), crosscheck.alias("semantic_crosscheck"), F.when(reason.isNull(), "verified").otherwise("discarded").alias("publication"), F.coalesce(channels, F.array().cast("array<string>")).alias("channels")
    )


def merged_authorities(origins: DataFrame) -> DataFrame:
    """Per merged record: the worst binding of its origins, the first reason, and whether it is published.

    All origins have to be verified and to agree on relevance.
    """
    order = F.struct("batch_id", "ordinal")
    rank = F.array_position(F.array(*map(F.lit, BINDINGS)), F.col("source_binding"))
    check = F.col("semantic_crosscheck")
    grouped = origins.groupBy(MERGED).agg(
        F.count("*").alias("n_origins"), F.collect_set("relevance").alias("_relevances"), F.max_by("source_binding", rank).alias("source_binding"), F.min_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("_reason"),
        F.bool_or(check == "disagrees").alias("_disagrees"), F.bool_or(check == "unknown").alias("_unknown"), F.bool_and(F.col("publication") == "verified").alias("_verified"),
        F.bool_and(~F.col("source_binding").isin("unlocated", "coverage_gap")).alias("_exact"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"),
    )
    agree = F.size("_relevances") == 1
    crosscheck = F.when(~agree, F.when(F.col("_exact"), "disagrees").otherwise("unknown")).when(F.col("_disagrees"), "disagrees").when(F.col("_unknown"), "unknown").otherwise("consistent")
    return grouped.select(
        *MERGED, "n_origins", F.when(agree, F.element_at("_relevances", 1)).alias("relevance"), F.when(agree, F.col("_reason")).otherwise("duplicate_record_relevance_disagreement").alias("reason"), "source_binding",
        crosscheck.alias("semantic_crosscheck"), F.when(F.col("_verified") & agree & (crosscheck == "consistent"), "verified").otherwise("discarded").alias("publication"), "channels",
    )


def package_vetoes(merged: DataFrame, annotations: DataFrame, records: DataFrame) -> DataFrame:
    """Per package: whether every annotation is of a record (else nothing is published), and whether a record disagrees with its relations, which vetoes the package."""
    stray = annotations.join(records.select(*RECORD), RECORD, "left_anti").select("package_id").distinct().withColumn("_stray", F.lit(True))
    sums = merged.groupBy("package_id").agg(F.count_if(F.col("publication") == "verified").alias("_published"), F.bool_or(F.col("semantic_crosscheck") == "disagrees").alias("_veto"))
    complete = F.col("_stray").isNull()
    return sums.join(stray, "package_id", "left").select("package_id", complete.alias("complete"), F.when(complete, F.col("_published")).otherwise(0).alias("published"), (complete & F.col("_veto")).alias("veto"))
