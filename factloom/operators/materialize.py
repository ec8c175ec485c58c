"""From drafted records and their citations to records that stand, with the reasons for those that do not, and the package's quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.support import evidence_spans, mandatory_span, only_points_elsewhere, span_supports
from factloom.functions.tokens import assertion_tokens, tokens_supported

from .citations import verify_citations
from .packages import readiness

RECORD = ("package_id", "kind", "id")
#: Why a record does not stand, the first that applies.
REASONS = ("duplicate_id", "unknown_document", "no_citation", "unverified_citation", "unsupported_value", "unsupported_statement", "unsupported_mandatory")


def verified_citations(citations: DataFrame, pages: DataFrame, compose: bool = True) -> DataFrame:
    """The citations (package_id, kind, id, ordinal, document_sha256, evidence_quote) with page, method and verified."""
    named = citations.withColumn("candidate_id", F.concat_ws("\x00", *RECORD, F.col("ordinal").cast("string")))
    found = verify_citations(named.select("candidate_id", "document_sha256", "evidence_quote"), pages, compose=compose)
    return named.join(found.select("candidate_id", "page", "method", "verified"), "candidate_id").drop("candidate_id")


def judged_records(records: DataFrame, citations: DataFrame, manifests: DataFrame, compose: bool = True) -> DataFrame:
    """The records (package_id, kind, id, text, category, document_sha256) with reason, status (active or needs_review), pages and n_citations.

    ``citations`` come from verified_citations().
    """
    known = manifests.select("package_id", "document_sha256").distinct().withColumn("known", F.lit(True))
    counted = records.withColumn("n_same", F.count("*").over(Window.partitionBy(*RECORD))).join(known, ["package_id", "document_sha256"], "left")
    proof = citations.select(*RECORD, F.col("document_sha256").alias("cited"), "evidence_quote", "page", "verified")
    cited = counted.select(*RECORD, "text", "document_sha256").dropDuplicates([*RECORD]).join(proof, [*RECORD])
    cited = cited.withColumn("valid", F.col("verified") & (F.col("cited") == F.col("document_sha256")))
    sums = cited.groupBy(*RECORD).agg(
        F.count("*").alias("n_citations"),
        F.bool_and("valid").alias("all_valid"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("valid"), assertion_tokens(F.col("evidence_quote"), compose))))).alias("shown"),
        F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("page")))).alias("pages"),
    )
    spans = cited.filter("valid").select(*RECORD, "text", F.explode(evidence_spans(F.col("evidence_quote"), compose)).alias("span"))
    said = span_supports(F.col("text"), F.col("span"), compose)
    backed = spans.groupBy(*RECORD).agg(F.bool_or(said).alias("stated"), F.bool_or(said & mandatory_span(F.col("span"))).alias("laid_down"))
    joined = counted.join(sums, [*RECORD], "left").join(backed, [*RECORD], "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    mandatory = (F.col("category") == "mandatory") & (no("laid_down") | only_points_elsewhere(F.col("text"), compose))
    tests = (F.col("n_same") > 1, no("known"), F.col("n_citations").isNull(), no("all_valid"), ~tokens_supported(assertion_tokens(F.col("text"), compose), F.col("shown")), no("stated"), F.coalesce(mandatory, F.lit(False)))
    reason = F.coalesce(*[F.when(test, name) for test, name in zip(tests, REASONS)])
    kept = joined.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "active").otherwise("needs_review"))
    return kept.select(*records.columns, "reason", "status", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def package_quality(judged: DataFrame, pages_per_package: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Per package: active and open records, covered pages of all, and readiness. What groups are cited is told by critical_groups().

    ``evaluation`` has package_id and fields, the number of evaluation fields with a value.
    """
    active = F.col("status") == "active"
    sums = judged.groupBy("package_id").agg(
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("open"),
        F.count_if(active & (F.col("kind") == "requirement")).alias("requirements"),
        F.sum(F.when(active, F.col("n_citations")).otherwise(0)).alias("verified_citations"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(active, F.transform("pages", lambda p: F.struct("document_sha256", p.alias("page")))))))).alias("covered_pages"),
    )
    joined = sums.join(pages_per_package, "package_id", "left").join(evaluation, "package_id", "left")
    state = readiness(F.col("requirements"), F.coalesce("fields", F.lit(0)), F.col("open"))
    return joined.select("package_id", "active", "open", "verified_citations", "covered_pages", F.coalesce("pages_total", F.lit(0)).alias("pages_total"), state.alias("readiness"))


def critical_groups(groups: DataFrame, citations: DataFrame, keys: tuple[str, ...] = ("kind", "id")) -> DataFrame:
    """Per package: its visible groups, and those that are cited: with a citation, and all of them verified and on a page.

    Groups and citations have package_id and the keys; a group that is named several times counts once.
    """
    sound = F.coalesce(F.col("verified") & F.col("page").isNotNull(), F.lit(False))
    cited = citations.groupBy("package_id", *keys).agg(F.bool_and(sound).alias("_cited"))
    joined = groups.select("package_id", *keys).distinct().join(cited, ["package_id", *keys], "left")
    return joined.groupBy("package_id").agg(F.count("*").alias("critical_groups"), F.count_if("_cited").alias("cited_groups"))


def summary_value(candidates: DataFrame) -> DataFrame:
    """Per package and field: the preferred value if the source has it, else the only value the source has, else null."""
    source = F.col("source_value")
    grouped = candidates.groupBy("package_id", "field").agg(F.first("preferred", ignorenulls=True).alias("preferred"), F.collect_set(source).alias("values"))
    value = F.when(F.array_contains("values", F.col("preferred")), F.col("preferred")).when(F.size("values") == 1, F.element_at("values", 1))
    return grouped.select("package_id", "field", value.alias("value"))


def blocking_unknowns(packages: DataFrame, *tests: tuple[str, F.Column]) -> DataFrame:
    """Per package the texts of the tests that hold, in order and once each."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in tests])))
    return packages.select("package_id", found.alias("unknowns"))
