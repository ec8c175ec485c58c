"""Queries on decisions and what they rest on over the driver tables, each with equal SQL.

Customers stand for packages, orders for batches and line items for units; the faults of the decisions follow from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import adjudication, alignment, authority, evaluation, fact_keys, facts, packages, pages
from factloom.sources.staging import stage
from factloom.sources.tables import table

from .structural import VERSIONS_SQL, _versions


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").dropDuplicates(["l_orderkey", "l_linenumber"])
    joined = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return joined.select(
        F.col("o_custkey").alias("package_id"), F.col("l_orderkey").alias("batch_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("candidate_id"),
        F.sha2(F.col("l_linenumber").cast("string"), 256).alias("document_sha256"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") % 3 + 1).alias("capacity"), F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("m"),
        F.lit(0).alias("core_start"), F.lit(2700).alias("core_end"), F.lit(0).alias("source_start"), F.lit(2950).alias("source_end"),
    )


def _adjudicated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = stage(_units(spark, sf_dir), "units")
    p, b, m = F.col("package_id"), F.col("batch_id"), F.col("m")
    headers = units.select("package_id").distinct().select(
        p, (p % 13 == 0).alias("capacity_exceeded"), (p % 17 != 0).alias("packing_complete"), F.lit(10).alias("expected_pages"), F.when(p % 19 == 0, 9).otherwise(10).alias("covered_pages"), (p % 23 != 0).alias("metadata_complete")
    )
    sent = units.filter(~((p % 31 == 0) & (F.col("page") == 1)))
    ids = F.array_sort(F.collect_list("candidate_id"))
    fragment = F.array(F.concat(F.lit("f"), F.col("batch_id").cast("string")))
    batches = sent.groupBy("package_id", "batch_id").agg(ids.alias("candidate_ids")).select("*", F.lit("digest").alias("ledger_digest"), fragment.alias("fragment_ids"), (b % 29 == 0).alias("tainted"))
    answered = batches.filter(b % 37 != 0).select("package_id", "batch_id", F.when(b % 43 == 0, "other").otherwise(F.col("ledger_digest")).alias("ledger_digest"), F.when(b % 47 == 0, F.reverse("candidate_ids")).otherwise(F.col("candidate_ids")).alias("candidate_ids"), "fragment_ids")
    responses = answered.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(b % 41 == 0, 2).otherwise(1)))).drop("_n")
    decided = sent.filter(m % 11 != 0).select(
        "package_id", "batch_id", F.when(m % 53 == 0, "elsewhere").otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(m % 17 == 0, "other").otherwise(F.col("document_sha256")).alias("document_sha256"),
        (F.col("page") + F.when(m % 19 == 0, 1).otherwise(0)).alias("page"), F.when(m % 23 == 0, "uncertain").otherwise("relevant").alias("coverage"), F.explode(F.sequence(F.lit(1), F.when(m % 13 == 0, 2).otherwise(1))).alias("_n"),
    ).drop("_n")
    start = F.when(m % 31 == 0, 100).otherwise(100 * F.col("ordinal")) + F.when(m % 5 == 0, 2650).otherwise(0)
    relations = sent.filter(m % 4 > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(1), (m % 4).cast("int")))).withColumn("relation_start", start).select(
        "package_id", "batch_id", "candidate_id", "ordinal", "relation_start", (F.col("relation_start") + F.when(m % 7 == 0, 501).otherwise(50)).alias("relation_end"), F.when(m % 3 == 0, F.col("relation_start")).alias("condition_start"),
        F.when(m % 3 == 0, F.col("relation_start") + F.when(m % 6 == 0, 51 * F.col("ordinal")).otherwise(10)).alias("condition_end"), F.when(m % 37 == 0, 0.5).otherwise(0.9).alias("confidence"),
        F.when(m % 41 == 0, "ambiguous").otherwise("whole_bid").alias("subject_scope"), F.when(m % 43 == 0, "unknown").otherwise("required").alias("modality"), F.when(m % 47 == 0, "unspecified").otherwise("email").alias("channel"),
    )
    return adjudication.adjudicated(headers, units.drop("batch_id", "m"), batches, responses, decided, relations)


JUDGED_SQL = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
u AS (SELECT o_custkey AS package_id, l_orderkey AS batch_id, l_orderkey || '-' || l_linenumber AS candidate_id, l_linenumber AS page, l_linenumber % 3 + 1 AS capacity, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE l_orderkey * 8 + l_linenumber END AS m FROM l JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT * FROM u WHERE NOT (package_id % 31 = 0 AND page = 1)),
p AS (SELECT package_id, CASE WHEN package_id % 13 = 0 OR package_id % 17 = 0 THEN 'capacity' WHEN package_id % 19 = 0 THEN 'incomplete_page_coverage' WHEN package_id % 23 = 0 THEN 'invalid_amendment_metadata'
  WHEN package_id % 31 = 0 AND bool_or(page = 1) THEN 'missing_candidate' END AS of_package FROM u GROUP BY 1),
b AS (SELECT package_id, batch_id, CASE WHEN batch_id % 37 = 0 THEN 'missing_batch' WHEN batch_id % 41 = 0 THEN 'duplicate_batch' WHEN batch_id % 43 = 0 THEN 'ledger_digest_mismatch' WHEN batch_id % 47 = 0 AND count(*) > 1 THEN 'batch_manifest_mismatch'
  WHEN batch_id % 29 = 0 THEN 'prompt_injection' WHEN bool_or(m % 53 = 0 AND m % 11 <> 0) THEN 'stray' END AS of_batch FROM s GROUP BY 1, 2),
r AS (SELECT candidate_id, m, CAST(o AS BIGINT) AS o, CASE WHEN m % 31 = 0 THEN 100 ELSE 100 * o END + CASE WHEN m % 5 = 0 THEN 2650 ELSE 0 END AS x, CASE WHEN m % 7 = 0 THEN 501 ELSE 50 END AS n FROM s, unnest(range(1, CAST(m % 4 AS BIGINT) + 1)) AS t(o)),
c AS (SELECT candidate_id, o, x, n, CASE WHEN x + n > 2950 THEN 'offset_mismatch' WHEN n > 500 THEN 'quote_too_long' WHEN x + (n - 1) // 2 >= 2700 THEN 'ownership_mismatch' WHEN m % 37 = 0 THEN 'low_confidence' WHEN m % 6 = 0 AND 51 * o > n THEN 'condition_mismatch'
  WHEN m % 41 = 0 OR m % 43 = 0 OR m % 47 = 0 THEN 'semantic_uncertainty' END AS reason FROM r),
f AS (SELECT candidate_id, count(*) AS k, arg_min(reason, o) FILTER (reason IS NOT NULL) AS reason, count(DISTINCT x) < count(*) AS twice FROM c GROUP BY 1),
j AS (SELECT u.package_id, u.batch_id, u.candidate_id, of_package, of_batch, coalesce(of_package, CASE WHEN of_batch = 'stray' THEN 'unknown_candidate' ELSE of_batch END,
  CASE WHEN m % 11 = 0 THEN 'missing_candidate' WHEN m % 13 = 0 THEN 'duplicate_candidate' WHEN m % 17 = 0 THEN 'sha_mismatch' WHEN m % 19 = 0 THEN 'page_mismatch' WHEN m % 23 = 0 THEN 'semantic_uncertainty' WHEN k > capacity THEN 'capacity'
  WHEN f.reason IS NOT NULL THEN f.reason WHEN twice THEN 'overlap_disagreement' END) AS reason, k FROM u JOIN p USING (package_id) LEFT JOIN b ON u.batch_id = b.batch_id LEFT JOIN f ON u.candidate_id = f.candidate_id)"""


def q_adjudicated_units(spark, sf_dir):
    return _adjudicated(spark, sf_dir)[0]


Q_UNITS = f"{JUDGED_SQL} SELECT package_id, candidate_id, reason, CASE WHEN reason IS NULL THEN coalesce(k, 0) ELSE 0 END AS n_relations FROM j"


def q_adjudication_headers(spark, sf_dir):
    return _adjudicated(spark, sf_dir)[1]


Q_HEADERS = f"""{JUDGED_SQL}, w AS (SELECT package_id, batch_id, bool_and(reason IS NULL) AS good, bool_or(of_batch IS NULL OR of_batch = 'stray') AS sound FROM j WHERE batch_id IN (SELECT batch_id FROM b) GROUP BY 1, 2),
n AS (SELECT package_id, count(*) AS expected_batches, count_if(good) AS good, count_if(sound) AS sound FROM w GROUP BY 1),
h AS (SELECT package_id, count(*) AS expected_units, count_if(reason IS NULL) AS verified_units, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, any_value(of_package) AS of_package FROM j GROUP BY 1)
SELECT package_id, expected_units, verified_units, coalesce(expected_batches, 0) AS expected_batches, CASE WHEN of_package IS NULL THEN good ELSE 0 END AS verified_batches, coalesce(expected_batches, 0) AS expected_fragments,
  CASE WHEN of_package IS NULL THEN sound ELSE 0 END AS verified_fragments, reasons, reasons = '' AS complete FROM h LEFT JOIN n USING (package_id)"""


def q_ledger_headers(spark, sf_dir):
    """Three documents a package: a base and two amendments, some of them misnumbered or with a page too few."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id IS NOT NULL")
    k = F.col("doc_id")
    sha = F.sha2(k.cast("string"), 256)
    package = F.floor(k / 3)
    pages = docs.select(package.alias("package_id"), sha.alias("document_sha256"), F.lit(1).alias("page"), "text")
    number = F.when(k % 3 == 0, F.lit(None)).when(package % 5 == 0, "1").when(package % 7 == 0, "A").otherwise((k % 3).cast("string"))
    documents = docs.select(package.alias("package_id"), sha.alias("document_sha256"), F.when(k % 3 == 0, "base").otherwise("amendment").alias("role"), number.alias("amendment_number"), F.when(k % 11 == 0, 2).otherwise(1).alias("pages_total"))
    units = adjudication.ledger_units(pages)
    return adjudication.ledger_headers(units.withColumn("n_mentions", F.lit(0)), documents)


Q_LEDGER = """WITH d AS (SELECT DISTINCT doc_id AS k, doc_id // 3 AS p, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT p, sum(CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END) AS expected_pages, count(*) AS covered_pages, sum(greatest(1, (n + 2699) // 2700)) AS n_units, bool_or(k % 11 = 0) AS short, count_if(k % 3 = 0) AS bases, count_if(k % 3 > 0) AS amendments, bool_or(k % 3 = 1) AS first FROM d GROUP BY 1)
SELECT p AS package_id, expected_pages, covered_pages, NOT short AND bases = 1 AND (amendments = 0 OR CASE WHEN p % 5 = 0 THEN amendments = 1 WHEN p % 7 = 0 THEN FALSE ELSE amendments = 2 OR first END) AS metadata_complete, n_units, n_units > 160 AS capacity_exceeded FROM s"""


def _origins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A record per document, which cites its own text once or twice; pairs of documents are merged into one record."""
    k, n = F.col("k"), F.length("text")
    sha = F.sha2(k.cast("string"), 256).alias("document_sha256")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text")).filter("k IS NOT NULL")
    place = [F.floor(k / 20).alias("package_id"), F.floor(k / 4).alias("batch_id"), F.lit("c").alias("kind"), (k % 4).alias("ordinal")]
    pair = F.floor(k / 2)
    records = docs.select(*place, pair.alias("record_id"), sha, (k % 29 == 0).alias("tainted"))
    relevance = F.when((pair % 3 == 2) & (k % 5 == 0), "u").when(pair % 3 == 0, "s").otherwise("n").alias("relevance")
    times = F.when(k % 23 == 0, 0).when(k % 19 == 0, 2).otherwise(1)
    annotations = docs.select(*place, relevance, F.explode(F.array_repeat(F.lit(1), times))).drop("col")
    annotations = annotations.unionByName(docs.filter(k % 97 == 0).select(*place[:3], F.lit(9).alias("ordinal"), F.lit("n").alias("relevance")))
    at = F.explode(F.when(n > 2760, F.array(F.lit(10), F.lit(2690))).otherwise(F.array(F.lit(10)))).alias("at")
    cited = docs.filter(k % 31 != 0).select("k", "text", at).withColumn("citation", F.when(F.col("at") == 10, 0).otherwise(1))
    elsewhere = F.when(k % 17 == 0, "elsewhere").otherwise(F.sha2(k.cast("string"), 256)).alias("document_sha256")
    citations = cited.select(*place, "citation", elsewhere, F.substring("text", F.col("at") + 1, F.lit(40)).alias("evidence_quote"))
    start = F.col("at") + F.when(k % 13 == 0, 1).otherwise(0)
    bindings = cited.select(*place, "citation", sha, F.lit(1).alias("page"), start.alias("start"), (start + 40).alias("end"))
    texts = docs.select(sha, F.lit(1).alias("page"), "text")
    units = pages.cores(docs.select("k", sha, F.lit(1).alias("page"), "text"), keep=("k", "document_sha256", "page")).filter((k + F.col("core")) % 7 != 0)
    units = units.withColumn("candidate_id", F.concat_ws("-", k.cast("string"), F.col("core").cast("string"))).withColumnsRenamed({"context_start": "source_start", "context_end": "source_end"})
    first = F.col("core") == 0
    spoken = units.filter((first & (k % 3 < 2)) | ((F.col("core") == 1) & (k % 2 == 0)))
    begin = F.when(~first, 2700).when(k % 3 == 0, 0).otherwise(20)
    second = first & (k % 3 == 1)
    relations = spoken.select(
        "candidate_id", begin.alias("relation_start"), F.when(~first, 2710).when(k % 3 == 0, 30).otherwise(60).alias("relation_end"), F.when(second & (k % 11 == 0), "ambiguous").otherwise("whole_bid").alias("subject_scope"),
        F.when(k % 37 == 0, "unknown").otherwise("required").alias("modality"), F.when(~second, "email").when(k % 4 == 0, "unspecified").otherwise("portal").alias("channel"),
    )
    return authority.origin_records(records, annotations, citations, bindings, texts, units, relations), annotations, records


ORIGINS_SQL = """WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, doc_id // 2 AS pair, CASE WHEN doc_id // 2 % 3 = 2 AND doc_id % 5 = 0 THEN 'u' WHEN doc_id // 2 % 3 = 0 THEN 's' ELSE 'n' END AS rel FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT *, a + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN a = 10 THEN 0 ELSE 1 END AS c FROM (SELECT *, unnest(CASE WHEN n > 2760 THEN [10, 2690] ELSE [10] END) AS a FROM d WHERE k % 31 <> 0)),
f AS (SELECT *, (k + c) % 7 <> 0 AND s + 19 < least(n, c * 2700 + 2700) AND s + 40 <= least(n, least(n, c * 2700 + 2700) + 250) AS covered, CASE WHEN c = 0 THEN k % 3 < 2 ELSE k % 2 = 0 END AS over,
  c = 0 AND k % 3 = 1 AS second, second AND k % 11 = 0 AS amb, NOT (second AND k % 4 = 0) AS named, k % 37 = 0 AS unk FROM c),
o AS (SELECT k, c, over, covered AND over AND NOT amb AND named AS whole, CASE WHEN second THEN 'portal' ELSE 'email' END AS channel, CASE WHEN k % 17 = 0 THEN 'cross_document_citation' WHEN substring(t, s + 1, 40) <> substring(t, a + 1, 40) THEN 'invalid_private_source_binding' WHEN NOT covered THEN 'incomplete_occurrence_coverage'
  WHEN rel = 's' AND NOT over THEN 'relationless_submission_record' WHEN rel = 's' AND (amb OR unk OR NOT named) THEN 'submission_relation_conflict' WHEN rel = 'n' AND over AND named THEN 'non_submission_relation_overlap' WHEN rel = 'u' THEN 'semantic_uncertainty' END AS why,
  substring(t, s + 1, 40) = substring(t, a + 1, 40) AND k % 17 <> 0 AS bound FROM f),
g AS (SELECT k, arg_min(why, c) FILTER (why IS NOT NULL) AS why, coalesce(list_sort(list(DISTINCT channel) FILTER (whole AND bound)), []) AS channels FROM o GROUP BY 1),
h AS (SELECT k, pair, rel AS told, CASE WHEN k % 23 = 0 THEN 'missing_annotation' WHEN k % 19 = 0 THEN 'duplicate_annotation' WHEN k % 29 = 0 THEN 'prompt_injection' WHEN k % 31 = 0 THEN 'missing_exact_citation' END AS before, why, channels FROM d LEFT JOIN g USING (k)),
r AS (SELECT k, pair, CASE WHEN k % 23 <> 0 AND k % 19 <> 0 THEN told END AS relevance, coalesce(before, why) AS reason, CASE WHEN before IS NOT NULL THEN 'unlocated' WHEN why IS NULL OR why = 'semantic_uncertainty' THEN 'exact_bound' WHEN why IN ('cross_document_citation', 'invalid_private_source_binding') THEN 'unlocated'
  WHEN why = 'incomplete_occurrence_coverage' THEN 'coverage_gap' WHEN why = 'relationless_submission_record' THEN 'relation_gap' ELSE 'relation_conflict' END AS source_binding,
  CASE WHEN reason IS NULL THEN 'consistent' WHEN before IS NULL AND (why IN ('relationless_submission_record', 'submission_relation_conflict', 'non_submission_relation_overlap', 'semantic_uncertainty') OR (why = 'incomplete_occurrence_coverage' AND told = 's')) THEN 'disagrees' ELSE 'unknown' END AS semantic_crosscheck,
  CASE WHEN reason IS NULL THEN 'verified' ELSE 'discarded' END AS publication, CASE WHEN before IS NULL THEN channels ELSE [] END AS channels FROM h)"""


def q_record_origins(spark, sf_dir):
    origins = _origins(spark, sf_dir)[0]
    return origins.select("package_id", "batch_id", "ordinal", "record_id", "relevance", "reason", "source_binding", "semantic_crosscheck", "publication", F.array_join("channels", ",").alias("channels"))


Q_ORIGINS = f"{ORIGINS_SQL} SELECT k // 20 AS package_id, k // 4 AS batch_id, k % 4 AS ordinal, pair AS record_id, relevance, reason, source_binding, semantic_crosscheck, publication, array_to_string(channels, ',') AS channels FROM r"


def q_record_authorities(spark, sf_dir):
    return authority.merged_authorities(_origins(spark, sf_dir)[0]).withColumn("channels", F.array_join("channels", ","))


MERGED_SQL = f"""{ORIGINS_SQL}, m AS (SELECT k // 20 AS package_id, pair AS record_id, count(*) AS n_origins, list(DISTINCT relevance) FILTER (relevance IS NOT NULL) AS rels, arg_min(reason, k) FILTER (reason IS NOT NULL) AS why,
  arg_max(source_binding, list_position(['exact_bound', 'unlocated', 'coverage_gap', 'relation_gap', 'relation_conflict'], source_binding)) AS source_binding, bool_or(semantic_crosscheck = 'disagrees') AS dis, bool_or(semantic_crosscheck = 'unknown') AS unk,
  bool_and(publication = 'verified') AS ver, bool_and(source_binding NOT IN ('unlocated', 'coverage_gap')) AS exact, array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels FROM r GROUP BY 1, 2),
a AS (SELECT package_id, 'c' AS kind, record_id, n_origins, CASE WHEN len(rels) = 1 THEN rels[1] END AS relevance, CASE WHEN coalesce(len(rels), 0) <> 1 THEN 'duplicate_record_relevance_disagreement' ELSE why END AS reason, source_binding,
  CASE WHEN coalesce(len(rels), 0) <> 1 THEN CASE WHEN exact THEN 'disagrees' ELSE 'unknown' END WHEN dis THEN 'disagrees' WHEN unk THEN 'unknown' ELSE 'consistent' END AS semantic_crosscheck,
  CASE WHEN ver AND len(rels) = 1 AND NOT dis AND NOT unk THEN 'verified' ELSE 'discarded' END AS publication, channels FROM m)"""
Q_AUTHORITIES = f"{MERGED_SQL} SELECT * FROM a"


def q_authority_vetoes(spark, sf_dir):
    origins, annotations, records = _origins(spark, sf_dir)
    return authority.package_vetoes(authority.merged_authorities(origins), annotations, records)


Q_VETOES = f"""{MERGED_SQL}, w AS (SELECT DISTINCT k // 20 AS package_id, TRUE AS stray FROM d WHERE k % 97 = 0)
SELECT package_id, stray IS NULL AS complete, CASE WHEN stray IS NULL THEN count_if(publication = 'verified') ELSE 0 END AS published, stray IS NULL AND bool_or(semantic_crosscheck = 'disagrees') AS veto FROM a LEFT JOIN w USING (package_id) GROUP BY package_id, stray"""


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rule per line item, whose field and faults follow from its keys, and what is cited for it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).groupBy("l_orderkey", "l_linenumber").agg(F.min("q").alias("q"))
    m, q, n = F.col("l_orderkey") + F.col("l_linenumber"), F.col("q"), F.col("l_linenumber") % 4
    text = lambda *parts: F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])
    shown = q + F.when(m % 5 == 0, 1).otherwise(0)
    field = F.when(n == 0, "technical_weight").when(n == 1, "rated_threshold").when(n == 2, "mandatory_gate").otherwise("selection_method")
    value = F.when(n == 0, text(q, "%")).when(n == 1, text(q, " out of 60")).when(n == 2, F.when(m % 3 == 0, "false").otherwise("true")).otherwise(F.when(m % 7 == 0, "best value").otherwise("Lowest price"))
    gate = F.when(m % 5 == 0, "Mandatory criteria may be required.").when(m % 3 == 0, "There are no mandatory criteria that bids must meet.").otherwise("All mandatory criteria must be met.")
    award = F.when(m % 5 == 0, "The award is not based on the lowest price.").otherwise("The award is based on the lowest price.")
    quote = F.when(n == 0, text("The technical weight is ", shown, "% and the price weight is ", 100 - shown, "%.")).when(n == 1, text("Bidders must obtain a minimum score of ", shown, " points out of 60.")).when(n == 2, gate).otherwise(award)
    key = [F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("rule_id")]
    verified = (m % 11 != 0).alias("verified")
    more = lines.filter((n == 0) & (m % 7 == 0)).select(*key, text("Technical: ", q + 2, " percent").alias("evidence_quote"), verified)
    return lines.select(*key, field.alias("field"), value.alias("value")), lines.select(*key, quote.alias("evidence_quote"), verified).unionByName(more)


RULES_SQL = """WITH l AS (SELECT l_orderkey AS package_id, l_linenumber AS rule_id, min(CAST(l_quantity AS INTEGER)) AS q, l_orderkey + l_linenumber AS m FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT package_id, rule_id, ['technical_weight', 'rated_threshold', 'mandatory_gate', 'selection_method'][rule_id % 4 + 1] AS field,
  CASE rule_id % 4 WHEN 0 THEN q || '%' WHEN 1 THEN q || ' out of 60' WHEN 2 THEN CASE WHEN m % 3 = 0 THEN 'false' ELSE 'true' END ELSE CASE WHEN m % 7 = 0 THEN 'best value' ELSE 'Lowest price' END END AS value,
  CASE WHEN rule_id % 4 = 0 THEN q || '.0' ELSE value END AS parsed, m % 11 <> 0 AND m % 5 <> 0 AND (rule_id % 4 NOT IN (0, 3) OR m % 7 <> 0) AS valid FROM l)"""


def q_evaluation_rules(spark, sf_dir):
    rules, citations = _rules(spark, sf_dir)
    return evaluation.validated_rules(rules, citations, compose=False).withColumn("parsed", evaluation.parsed_value(F.col("field"), F.col("value")))


Q_RULES = f"{RULES_SQL} SELECT package_id, rule_id, field, value, parsed, valid, CAST(valid AS INTEGER) AS n_bound FROM r"


def q_evaluation_fields(spark, sf_dir):
    rules = q_evaluation_rules(spark, sf_dir)
    return packages.evaluation_fields(rules.withColumns({"status": F.when(F.col("valid"), "active").otherwise("needs_review"), "value": F.col("parsed")}))


Q_FIELDS = f"{RULES_SQL} SELECT package_id, " + ", ".join(f"CASE WHEN count(DISTINCT parsed) FILTER (field = '{f}') = 1 THEN max(parsed) FILTER (field = '{f}') END AS {f}" for f in packages.EVALUATION_FIELDS) + " FROM r WHERE valid GROUP BY 1"


def q_package_facts(spark, sf_dir):
    """Facts of two collections, reconciled as one package."""
    versions = facts.topic_keys(_versions(spark, sf_dir), compose=False)
    claim = F.split_part(F.col("id"), F.lit("-"), F.lit(4)).cast("int") % 2 == 1
    done = facts.reconcile_together({"claim": versions.filter(claim), "requirement": versions.filter(~claim)}, compose=False)
    return done.select("package_id", "collection", "id", "status")


TOGETHER_SQL = VERSIONS_SQL.replace("concat_ws(", "CASE WHEN l_suppkey % 2 = 1 THEN 'claim:' ELSE 'requirement:' END || concat_ws(")
Q_TOGETHER = f"WITH {TOGETHER_SQL} SELECT CAST(p AS VARCHAR) AS package_id, split_part(id, ':', 1) AS collection, split_part(id, ':', 2) AS id, CASE WHEN effect = 'add' OR (am AND ok AND n > 1) THEN status ELSE 'needs_review' END AS status FROM r"


def q_supported_conflicts(spark, sf_dir):
    """Orders stand for conflicts, their lines for citations and suppliers for origins, some of which are discarded."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id").join(orders, "id")
    citations = lines.select("package_id", "id", (F.col("l_returnflag") != "R").alias("verified"), F.nullif(F.col("l_linenumber"), F.lit(7)).alias("page"))
    origins = lines.select("package_id", "id", F.col("l_suppkey").alias("origin"))
    return facts.supported_conflicts(orders, citations, origins, origins.filter(F.col("origin") % 7 == 0).select("package_id", "origin").filter(F.col("package_id") % 2 == 0))


Q_SUPPORTED = """WITH l AS (SELECT o_custkey AS package_id, l_orderkey AS id, l_returnflag <> 'R' AND l_linenumber <> 7 AS ok, o_custkey % 2 = 0 AND l_suppkey % 7 = 0 AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT package_id, id FROM l GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_and(ok) AND NOT bool_or(gone)"""


def q_text_occurrences(spark, sf_dir):
    """Where the first two characters of a turn start in it again."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    found = alignment.occurrences(F.col("text"), F.substring("text", 1, 2))
    return turns.select("conv_id", "turn", F.array_join(found, ",").alias("starts"))


Q_OCCURRENCES = """SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN '' ELSE array_to_string(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, least(2, length(text))) = substring(text, 1, 2)), ',') END AS starts FROM conversations"""


def q_quote_selectors(spark, sf_dir):
    """A stretch of each turn with its spaces doubled, searched for in the turns of its conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), " +", " "))
    quote = F.regexp_replace(F.substring("text", 4, 12), " ", " \n")
    quotes = turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("quote_id"), "conv_id", quote.alias("quote"))
    fragments = turns.select("conv_id", F.col("turn").alias("fragment_id"), "text")
    return alignment.unique_places(quotes, fragments, "conv_id").drop("quote")


Q_SELECTORS = """WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), ' +', ' ', 'g') AS text FROM conversations), q AS (SELECT conv_id || '-' || turn AS quote_id, conv_id, substring(text, 4, 12) AS quote FROM t),
p AS (SELECT quote_id, turn, CASE WHEN quote <> '' AND NOT regexp_matches(quote, '^\\s|\\s$') THEN list_filter(range(0, length(text)), lambda i: substring(text, i + 1, length(quote)) = quote) END AS places, length(quote) AS n FROM q JOIN t USING (conv_id)),
s AS (SELECT quote_id, sum(coalesce(len(places), 0)) AS n_places, bool_or(places IS NULL) AS refused, max(CASE WHEN len(places) > 0 THEN turn END) AS turn, max(places[1]) AS place, any_value(n) AS n FROM p GROUP BY 1)
SELECT quote_id, conv_id, n_places, CASE WHEN n_places = 1 AND NOT refused THEN turn END AS fragment_id, CASE WHEN n_places = 1 AND NOT refused THEN place END AS start, CASE WHEN n_places = 1 AND NOT refused THEN place + n END AS "end" FROM q JOIN s USING (quote_id)"""


def q_sealed_manifests(spark, sf_dir):
    """Customers' rows sealed, some of them changed since."""
    now = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    before = now.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, "other").otherwise(F.col("c_name")))
    return alignment.intact(alignment.sealed(before, "c_custkey", "c_name", "c_nationkey"), now, "c_custkey", "c_name", "c_nationkey")


Q_SEALED = """WITH b AS (SELECT c_custkey, '{"c_name":"' || CASE WHEN c_custkey % 10 = 0 THEN 'other' ELSE c_name END || '","c_nationkey":' || c_nationkey || '}' AS j FROM customer)
SELECT c_custkey, sha256(j) AS digest, strlen(j) AS bytes, TRUE AS fits, c_custkey % 10 <> 0 AS intact FROM b"""


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per key, with its quantity and a number from its keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).groupBy("l_orderkey", "l_linenumber").agg(F.min("q").alias("q"))
    return lines.select(F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("id"), "q", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("m"))


SOURCED_SQL = "WITH l AS (SELECT l_orderkey AS package_id, l_linenumber AS id, min(CAST(l_quantity AS INTEGER)) AS q, l_orderkey * 8 + l_linenumber AS m FROM lineitem GROUP BY ALL)"


def _worded(template: str, number) -> F.Column:
    return F.replace(F.lit(template), F.lit("#"), number.cast("string"))


def _by(m, *cases) -> F.Column:
    out = F.when(m % len(cases) == 0, cases[0])
    for n, case in enumerate(cases[1:], 1):
        out = out.when(m % len(cases) == n, case)
    return out


def q_source_keys(spark, sf_dir):
    """Facts whose sources are worded in eight ways; some have another value, are not verified, or cite another document."""
    m, q = F.col("m"), F.col("q")
    kinds = F.floor(m / 8) + F.col("id")
    quotes = ("The deductible of the insurance is # in total.", "The contract end date is year # at last.", "The projection horizon is year # at last.", "Basis of payment in its entirety is set at # items.", "See appendix 1 compliance table row # there.", "Commercial general liability coverage is # in total.", "Parking is for # cars.", "The deductible of the insurance is # in total. The insurance contact is person # there.")
    lines = _sourced(spark, sf_dir)
    given = lines.select("package_id", "id", F.when(kinds % 13 == 0, "Table of values").otherwise("Values").alias("topic"), (q + F.when(kinds % 5 == 0, 100).otherwise(0)).cast("string").alias("value"), F.lit("d").alias("document_sha256"))
    citations = lines.select("package_id", "id", F.when(kinds % 11 == 0, "e").otherwise("D").alias("document_sha256"), _by(kinds, *[_worded(t, q) for t in quotes]).alias("evidence_quote"), (kinds % 7 != 0).alias("verified"))
    return fact_keys.source_keys(given, citations, compose=False)


Q_SOURCE_KEYS = f"""{SOURCED_SQL}, k AS (SELECT *, m // 8 + id AS n FROM l)
SELECT package_id, id, CASE n % 8 WHEN 0 THEN 'insurance:deductible' WHEN 1 THEN 'contract:end' WHEN 2 THEN 'projection:horizon' WHEN 3 THEN 'document:basis-of-payment' WHEN 4 THEN 'document:m3-appendix-1:row:' || lpad(CAST(q AS VARCHAR), 2, '0') ELSE 'insurance:cgl:coverage' END AS source_key
FROM k WHERE n % 5 > 0 AND n % 7 > 0 AND n % 11 > 0 AND n % 8 < 6 AND (n % 13 > 0 OR n % 8 = 4)"""


def q_deadline_keys(spark, sf_dir):
    """Deadlines in four wordings; of an extended one only the new date counts."""
    kinds, d = F.floor(F.col("m") / 8) + F.col("id"), F.col("q") % 28 + 1
    quotes = ("Questions must be submitted by March #, 2021.", "Bids must be received by March #, 2021.", "The closing date is extended from March #, 2021 to April #, 2021.", "Deliveries are expected on March #, 2021.")
    value = F.when(kinds % 5 == 0, _worded("May #, 2021", d)).when((kinds % 4 == 2) & (kinds % 3 > 0), _worded("April #, 2021", d)).otherwise(_worded("March #, 2021", d))
    lines = _sourced(spark, sf_dir)
    citations = lines.select("package_id", "id", _by(kinds, *[_worded(t, d) for t in quotes]).alias("evidence_quote"), (kinds % 7 != 0).alias("verified"))
    return fact_keys.deadline_keys(lines.select("package_id", "id", value.alias("value")), citations, compose=False)


Q_DEADLINES = f"""{SOURCED_SQL}, k AS (SELECT *, m // 8 + id AS n FROM l)
SELECT package_id, id, CASE WHEN n % 4 = 0 THEN 'deadline:questions' ELSE 'deadline:solicitation' END AS deadline_key FROM k WHERE n % 5 > 0 AND n % 7 > 0 AND n % 4 < 3 AND (n % 4 < 2 OR n % 3 > 0)"""


def q_mutation_targets(spark, sf_dir):
    kinds, q = F.floor(F.col("m") / 8) + F.col("id"), F.col("q")
    quotes = ("the limit is amended from # to 9#", "the amount is replaced by 9# instead of #", "new value is 9#", "the limit stays at #", "the revised technical ratio is 9# and not #", "the fee was changed to # and is now increased to 9#")
    return _sourced(spark, sf_dir).select("package_id", "id", fact_keys.mutation_target(_by(kinds, *[_worded(t, q) for t in quotes])).alias("target"))


Q_TARGETS = f"{SOURCED_SQL} SELECT package_id, id, CASE WHEN (m // 8 + id) % 6 <> 3 THEN '9' || q END AS target FROM l"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, q = F.floor(F.col("m") / 8) + F.col("id"), F.col("q")
    findings = ("The insurance deductible is #", "The deadline for questions is # days ahead", "The insurance deductible is # but the closing date is near", "Parking is scarce for # cars")
    lines = _sourced(spark, sf_dir)
    value = _by(kinds, *[_worded(t, q) for t in findings])
    citations = lines.select("package_id", "id", F.lit("d").alias("document_sha256"), F.when(kinds % 5 == 0, "Nothing of this applies here.").otherwise(F.concat(value, F.lit(", all told."))).alias("evidence_quote"), (kinds % 7 != 0).alias("verified"))
    return fact_keys.risk_lineage(lines.select("package_id", "id", value.alias("value"), F.lit("d").alias("document_sha256")), citations, compose=False)


RISKS_SQL = f"""{SOURCED_SQL}, k AS (SELECT *, m // 8 + id AS n FROM l),
r AS (SELECT package_id, id, q, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN [] ELSE CASE n % 4 WHEN 0 THEN ['insurance:deductible'] WHEN 1 THEN ['deadline:questions'] WHEN 2 THEN ['deadline:solicitation', 'insurance:deductible'] ELSE [] END END AS keys FROM k)"""


def q_risk_lineage(spark, sf_dir):
    return _risks(spark, sf_dir).select("package_id", "id", "lineage", F.array_join("keys", ",").alias("keys"))


Q_RISKS = f"{RISKS_SQL} SELECT package_id, id, CASE len(keys) WHEN 0 THEN 'unbound' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS lineage, array_to_string(keys, ',') AS keys FROM r"


def q_stale_risks(spark, sf_dir):
    """Every other line stands for a superseded amount of the deductible, some for one in conflict."""
    status = F.when((F.col("package_id") % 9 == 0) & (F.col("id") == 1), "conflicted").when(F.col("id") % 2 == 1, "superseded").otherwise("active")
    known = _sourced(spark, sf_dir).select("package_id", F.lit("insurance:deductible").alias("fact_key"), _worded("#", F.col("q")).alias("value"), status.alias("status"))
    return fact_keys.stale_risks(_risks(spark, sf_dir), known, compose=False).select("package_id", "id", "dependency")


Q_STALE = f"""{RISKS_SQL}, g AS (SELECT package_id, q FROM l GROUP BY 1, 2 HAVING bool_or(id % 2 = 1) AND NOT bool_or(id % 2 = 0) AND package_id % 9 > 0),
d AS (SELECT DISTINCT package_id FROM l WHERE package_id % 9 = 0 AND id = 1), h AS (SELECT * FROM g UNION ALL SELECT package_id, q FROM l WHERE package_id % 9 = 0 AND package_id NOT IN (SELECT package_id FROM d) GROUP BY 1, 2 HAVING bool_or(id % 2 = 1) AND NOT bool_or(id % 2 = 0))
SELECT r.package_id, r.id, CASE WHEN h.q IS NULL OR NOT list_contains(keys, 'insurance:deductible') THEN NULL WHEN len(keys) = 1 THEN 'stale' ELSE 'ambiguous' END AS dependency FROM r LEFT JOIN h ON r.package_id = h.package_id AND r.q = h.q"""


SQL = {
    "q_adjudicated_units": Q_UNITS, "q_adjudication_headers": Q_HEADERS, "q_ledger_headers": Q_LEDGER, "q_record_origins": Q_ORIGINS, "q_record_authorities": Q_AUTHORITIES, "q_authority_vetoes": Q_VETOES,
    "q_evaluation_rules": Q_RULES, "q_evaluation_fields": Q_FIELDS, "q_package_facts": Q_TOGETHER, "q_supported_conflicts": Q_SUPPORTED, "q_text_occurrences": Q_OCCURRENCES, "q_quote_selectors": Q_SELECTORS, "q_sealed_manifests": Q_SEALED,
    "q_source_keys": Q_SOURCE_KEYS, "q_deadline_keys": Q_DEADLINES, "q_mutation_targets": Q_TARGETS, "q_risk_lineage": Q_RISKS, "q_stale_risks": Q_STALE,
}
QUERIES = {name: globals()[name] for name in SQL}
