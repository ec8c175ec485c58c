"""Coverage ledgers of submission channels, and the check of the decisions that come back for their units.

A package has units (candidate_id, document_sha256, page and the spans of its core and source), batches that say which
units and fragments each was sent, responses that repeat this, a decision per unit, and relations in decisions.
Everything is keyed by package_id; a batch's lists of ids are bounded by what one batch may carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.staging import stage

from . import pages
from .coverage import checked_relations, mentions

# The most units of a package, and the most relations of a unit.
MOST_UNITS, MOST_RELATIONS = 160, 10
PACKAGE, BATCH = ["package_id"], ["package_id", "batch_id"]
UNIT = ["package_id", "candidate_id"]


def ledger_units(page_rows: DataFrame) -> DataFrame:
    """The units of pages (package_id, document_sha256, page, text): one per core, with the mentions that it owns.

    Adds n_mentions, the channel if there is one mention only (else unspecified), the capacity for relations and an
    id that follows from document, page, text and core.
    """
    keys = ("package_id", "document_sha256", "page")
    hashed = page_rows.select(*keys, F.coalesce("text", F.lit("")).alias("text")).withColumns({"text_sha256": F.sha2("text", 256), "page_chars": F.length("text")})
    cores = pages.cores(hashed, keep=(*keys, "text_sha256", "page_chars"))
    owned = mentions(hashed, keys).filter("core IS NOT NULL").groupBy(*keys, "core").agg(F.count("*").alias("n_mentions"), F.min("channel").alias("_channel"))
    joined = cores.join(owned, [*keys, "core"], "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))
    identity = F.sha2(F.concat_ws("\x00", "document_sha256", F.col("page").cast("string"), "text_sha256", F.col("core").cast("string"), F.col("n_mentions").cast("string")), 256)
    capacity = F.when(F.col("page_chars") == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(MOST_RELATIONS), "n_mentions")))
    return joined.select(
        *keys, F.substring(identity, 1, 32).alias("candidate_id"), "core", "page_chars", "core_start", "core_end", F.col("context_start").alias("source_start"), F.col("context_end").alias("source_end"),
        "n_mentions", F.when(F.col("n_mentions") == 1, F.col("_channel")).otherwise("unspecified").alias("channel"), capacity.cast("long").alias("capacity"),
    )


def numbered_without_gap(amendment: Column) -> Column:
    """Whether the amendments' labels, an array, are the numbers from one on, each once."""
    numbers = F.array_sort(F.transform(amendment, lambda a: F.regexp_extract(a, r"^0*(\d+)$", 1).try_cast("int")))
    return F.forall(F.transform(numbers, lambda n, i: n == i + 1), lambda ok: F.coalesce(ok, F.lit(False)))


def ledger_headers(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Per package of documents (package_id, document_sha256, role, amendment_number, pages_total): pages, metadata and capacity.

    A document listed twice under the same role and number counts once. Pages that do not run from one to pages_total, more
    or fewer than one base, a base with a number, or amendments not numbered from one make the metadata incomplete.
    """
    listed = documents.dropDuplicates(["package_id", "role", "amendment_number", "document_sha256"])
    page_sums = pages.core_coverage(units, ("package_id", "document_sha256", "page"), "page_chars").groupBy("package_id", "document_sha256").agg(
        F.count("*").alias("_pages"), F.count_if(F.col("complete")).alias("_covered"), F.min("page").alias("_first"), F.max("page").alias("_last")
    )
    known = listed.join(page_sums, ["package_id", "document_sha256"], "left")
    in_order = F.coalesce((F.col("_pages") == F.col("pages_total")) & (F.col("_first") == 1) & (F.col("_last") == F.col("_pages")), F.col("pages_total") == 0)
    base = F.col("role") == "base"
    sums = known.groupBy("package_id").agg(
        F.sum("pages_total").alias("expected_pages"), F.sum(F.coalesce(F.least("_covered", "pages_total"), F.lit(0))).alias("covered_pages"),
        (F.bool_and(in_order) & (F.count_if(base) == 1) & ~F.bool_or(base & F.col("amendment_number").isNotNull()) & numbered_without_gap(F.collect_list(F.when(~base, F.coalesce("amendment_number", F.lit("")))))).alias("metadata_complete"),
    )
    full = units.groupBy("package_id").agg(F.count("*").alias("n_units"), F.max("n_mentions").alias("_most"))
    joined = sums.join(full, "package_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    return joined.withColumn("capacity_exceeded", (F.col("n_units") > MOST_UNITS) | F.coalesce(F.col("_most") > MOST_RELATIONS, F.lit(False))).drop("_most")


def package_reasons(headers: DataFrame, units: DataFrame, batches: DataFrame) -> DataFrame:
    """Headers (with packing_complete) and ``reason``, the first that keeps the package's decisions from being looked at, or null."""
    sent = batches.select("package_id", F.explode("candidate_ids").alias("candidate_id")).groupBy(UNIT).agg(F.count("*").alias("_times"))
    each = units.select(*UNIT).distinct().withColumn("_known", F.lit(True)).join(sent, UNIT, "full").groupBy("package_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("_unknown"), F.bool_or(F.col("_known") & (F.col("_times") > 1)).alias("_twice"), F.bool_or(F.col("_known") & F.col("_times").isNull()).alias("_missing")
    )
    reason = (
        F.when(F.col("capacity_exceeded") | ~F.col("packing_complete"), "capacity")
        .when(F.col("expected_pages") != F.col("covered_pages"), "incomplete_page_coverage")
        .when(~F.col("metadata_complete"), "invalid_amendment_metadata")
        .when(F.col("_unknown"), "unknown_candidate")
        .when(F.col("_twice"), "duplicate_candidate")
        .when(F.col("_missing"), "missing_candidate")
    )
    return headers.join(each, "package_id", "left").withColumn("reason", reason).drop("_unknown", "_twice", "_missing")


def batch_reasons(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Per batch sent or answered: ``reason`` against its transport, or null. A batch that was answered only is unknown."""
    # A batch answered twice is refused, so which answer is looked at does not matter.
    told = responses.groupBy(BATCH).agg(F.count("*").alias("_answers"), *[F.max(c).alias("_" + c) for c in ("ledger_digest", "candidate_ids", "fragment_ids")])
    same = F.col("_candidate_ids").eqNullSafe(F.col("candidate_ids")) & F.col("_fragment_ids").eqNullSafe(F.col("fragment_ids"))
    reason = (
        F.when(F.col("tainted").isNull(), "unknown_batch")
        .when(F.col("_answers").isNull(), "missing_batch")
        .when(F.col("_answers") > 1, "duplicate_batch")
        .when(~F.col("_ledger_digest").eqNullSafe(F.col("ledger_digest")), "ledger_digest_mismatch")
        .when(~same, "batch_manifest_mismatch")
        .when(F.col("tainted"), "prompt_injection")
    )
    return batches.join(told, BATCH, "full").select(*BATCH, "candidate_ids", F.coalesce(F.size("fragment_ids"), F.lit(0)).alias("n_fragments"), reason.alias("batch_reason"))


def relation_reasons(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Per batch and unit: the reason against its first relation that has one, how many it has, and whether two share a span."""
    # The same page in two packages has the same units.
    checked = checked_relations(relations, units.dropDuplicates(["candidate_id"]))
    spans = F.size(F.collect_set(F.when(F.col("relation_start").isNotNull() & F.col("relation_end").isNotNull(), F.struct("relation_start", "relation_end"))))
    return checked.groupBy(*BATCH, "candidate_id").agg(F.count("*").alias("n_relations"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ordinal"))).alias("relation_reason"), (spans < F.count("*")).alias("same_span"))


def stray_batches(batches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sound batches (as batch_reasons gives them) that were answered with decisions on units they were not sent."""
    sound = batches.filter("batch_reason IS NULL")
    sent = sound.select(*BATCH, F.explode("candidate_ids").alias("candidate_id"))
    # Few decisions are on units not sent, so these are what the sound batches are asked for.
    return decisions.select(*BATCH, "candidate_id").join(sent, [*BATCH, "candidate_id"], "left_anti").select(*BATCH).distinct().join(sound.select(*BATCH), BATCH, "left_semi")


def unit_records(units: DataFrame, batches: DataFrame, decisions: DataFrame, relations: DataFrame, stray: DataFrame | None = None) -> DataFrame:
    """Each unit of the batches (as batch_reasons gives them) with the first reason against it, null if its decision is verified.

    ``stray`` is what stray_batches gives, if that is at hand.
    """
    stray = (stray_batches(batches, decisions) if stray is None else stray).withColumn("_stray", F.lit(True))
    sent = batches.filter("candidate_ids IS NOT NULL").join(stray, BATCH, "left").select(*BATCH, "batch_reason", "_stray", F.explode("candidate_ids").alias("candidate_id"))
    per_unit = decisions.groupBy(*BATCH, "candidate_id").agg(F.count("*").alias("_decisions"), F.max("document_sha256").alias("_sha"), F.max("page").alias("_page"), F.max("coverage").alias("_coverage"))
    joined = (
        sent.join(per_unit, [*BATCH, "candidate_id"], "left")
        .join(relation_reasons(relations, units), [*BATCH, "candidate_id"], "left")
        .join(units.select(*UNIT, "document_sha256", "page", "capacity"), UNIT)
    )
    reason = (
        F.when(F.col("batch_reason").isNotNull(), F.col("batch_reason"))
        .when(F.col("_stray"), "unknown_candidate")
        .when(F.col("_decisions").isNull(), "missing_candidate")
        .when(F.col("_decisions") > 1, "duplicate_candidate")
        .when(~F.col("_sha").eqNullSafe(F.col("document_sha256")), "sha_mismatch")
        .when(~F.col("_page").eqNullSafe(F.col("page")), "page_mismatch")
        .when(F.col("_coverage") == "uncertain", "semantic_uncertainty")
        .when(F.col("n_relations") > F.col("capacity"), "capacity")
        .when(F.col("relation_reason").isNotNull(), F.col("relation_reason"))
        .when(F.col("same_span"), "overlap_disagreement")
    )
    return joined.select(*BATCH, "candidate_id", "document_sha256", "page", reason.alias("reason"), (F.when(reason.isNull(), F.coalesce("n_relations", F.lit(0))).otherwise(0)).alias("n_relations"))


def adjudicated(headers: DataFrame, units: DataFrame, batches: DataFrame, responses: DataFrame, decisions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, headers): a row per unit with its reason, or null if verified, and a row per package with its counts.

    A package with a reason of its own has no verified unit. ``complete`` says that it has units and nothing speaks against any.
    What several steps read is staged, so that its joins are done once.
    """
    whole = package_reasons(headers, units, batches)
    transport = stage(batch_reasons(batches, responses), "transport")
    stray = stage(stray_batches(transport, decisions), "stray")
    judged = stage(unit_records(units, transport, decisions, relations, stray).select(*UNIT, "batch_id", "reason", "n_relations"), "judged")
    first = whole.select("package_id", F.col("reason").alias("_package"))
    # Without a reason against the package each of its units is in one batch.
    one = judged.groupBy(UNIT).agg(F.min("reason").alias("_reason"), F.max("n_relations").alias("_n"))
    records = units.select(*UNIT).join(first, "package_id").join(one, UNIT, "left").select(
        *UNIT, F.coalesce("_package", "_reason").alias("reason"), F.when(F.col("_package").isNull(), F.coalesce("_n", F.lit(0))).otherwise(0).alias("n_relations")
    )
    of_units = records.groupBy("package_id").agg(F.count("*").alias("expected_units"), F.count_if(F.col("reason").isNull()).alias("verified_units"), F.collect_set("reason").alias("_of_units"))
    whole_batches = judged.groupBy(BATCH).agg(F.bool_and(F.col("reason").isNull()).alias("_all"))
    sound = F.col("batch_reason").isNull()
    stray = stray.withColumn("_stray", F.lit("unknown_candidate"))
    of_batches = transport.join(whole_batches, BATCH, "left").join(stray, BATCH, "left").groupBy("package_id").agg(
        F.count_if(F.col("candidate_ids").isNotNull()).alias("expected_batches"), F.count_if(sound & F.coalesce("_all", F.lit(True))).alias("_batches"),
        F.sum("n_fragments").alias("expected_fragments"), F.sum(F.when(sound, F.col("n_fragments")).otherwise(0)).alias("_fragments"), F.array_union(F.collect_set("batch_reason"), F.collect_set("_stray")).alias("_of_batches"),
    )
    none = F.array().cast("array<string>")
    mine = F.array_sort(F.array_union(F.coalesce("_of_units", none), F.coalesce("_of_batches", none)))
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(mine)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    unless = lambda c: F.when(F.col("reason").isNull(), zero(F.col(c))).otherwise(0)
    summed = whole.join(of_units, "package_id", "left").join(of_batches, "package_id", "left").select(
        "package_id", zero(F.col("expected_units")).alias("expected_units"), unless("verified_units").alias("verified_units"), zero(F.col("expected_batches")).alias("expected_batches"), unless("_batches").alias("verified_batches"),
        zero(F.col("expected_fragments")).alias("expected_fragments"), unless("_fragments").alias("verified_fragments"), F.array_join(reasons, ",").alias("reasons"),
    )
    complete = (F.col("expected_units") > 0) & (F.col("reasons") == "") & (F.col("verified_units") == F.col("expected_units")) & (F.col("verified_fragments") == F.col("expected_fragments"))
    return records, summed.withColumn("complete", complete)
