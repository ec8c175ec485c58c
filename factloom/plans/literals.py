"""Queries over small literal tables in the language of tenders, which the driver tables do not have; their SQL states the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import predicates as C
from factloom.functions import support as P
from factloom.functions import text as T
from factloom.functions import tokens as K
from factloom.operators import anchors, answers, citations, coverage, estimates, extract, facts, materialize, packages, pages
from factloom.sources.tables import FACTS

ASSERTIONS = [
    ("iso", "2026-09-15 at 14:00", ["date:2026-09-15", "time:14:00"]),
    ("words", "September 15, 2026, 2:00 PM MDT", ["date:2026-09-15", "time:14:00", "timezone:mdt", "utc-offset:-06:00"]),
    ("bound", "at least 1,500.50 CAD", ["bound:minimum", "currency:cad", "number:1500.5"]),
    ("percent", "30 percent", ["number:30", "percent:30"]),
    ("magnitude", "5 million", ["magnitude:million", "number:5"]),
    ("dayfirst", "3rd Sept 2025 at 12:05 a.m.", ["date:2025-09-03", "time:00:05"]),
    ("notdate", "2026-13-15 and 24:00", ["number:0", "number:13", "number:15", "number:2026", "number:24"]),
    ("offset", "closes 2026-01-02T10:30:00-05:00", ["date:2026-01-02", "time:10:30", "utc-offset:-05:00"]),
    ("two", "not exceeding 007 items, exactly 12 %", ["bound:exact", "bound:maximum", "number:12", "number:7", "percent:12"]),
    ("none", "no scalar here", []),
]


def q_assertion_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t, _ in ASSERTIONS], "id string, text string")
    return rows.select("id", F.array_join(K.assertion_tokens(F.col("text")), " ").alias("tokens"))


def _values(names: str, rows: list[tuple]) -> str:
    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


SUPPORT = [("s1", "due 2026-09-15", "The closing date is September 15, 2026 at 2 pm", True), ("s2", "due 2026-09-16", "The closing date is September 15, 2026", False), ("s3", "no scalar", "anything", True), ("s4", "at most 10 %", "10 percent", False)]


def q_token_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in SUPPORT], "id string, assertion string, quote string")
    return rows.select("id", K.tokens_supported(K.assertion_tokens(F.col("assertion")), K.assertion_tokens(F.col("quote"))).alias("supported"))


#: A base document, an amendment that moves the closing date, and one that contradicts itself on the horizon.
FACT_ROWS = [
    ("p", "close-base", "closing date", "closing", "2026-09-03 14:00", "d0", "base", None, "add", True),
    ("p", "close-002", "closing date", "closing", "2026-09-15 14:00", "d2", "amendment", "002", "replace", True),
    ("p", "pay-base", "basis of payment", "payment", "firm price", "d0", "base", None, "add", True),
    ("p", "pay-001", "basis of payment", "payment", "limitation of expenditure", "d1", "amendment", "001", "replace", True),
    ("p", "hor-base", "projection horizon", "horizon", "2040", "d0", "base", None, "add", True),
    ("p", "hor-003-a", "projection horizon", "horizon", "2050", "d3", "amendment", "003", "replace", True),
    ("p", "hor-003-b", "projection horizon", "horizon", "2055", "d3", "amendment", "003", "replace", True),
    ("p", "hor-003-c", "projection horizon", "horizon", "2050", "d3", "amendment", "003", "replace", True),
    ("p", "new-003", "insurance", "insurance", "two million", "d3", "amendment", "003", "replace", True),
    ("p", "unverified", "security", "security", "reliability", "d0", "base", None, "add", False),
    ("p", "alias-1", "final report page limit", None, "40 pages", "d0", "base", None, "add", True),
    ("p", "alias-2", "final report limit", None, "40 pages", "d1", "amendment", "001", "add", True),
    ("p", "apart", "interim report annex limit", None, "40 pages", "d1", "amendment", "001", "add", True),
]
STATUS = {"close-base": "superseded", "close-002": "active", "pay-base": "superseded", "pay-001": "active", "hor-base": "superseded", "hor-003-a": "conflicted", "hor-003-b": "conflicted", "hor-003-c": "conflicted", "new-003": "superseded", "unverified": "superseded", "alias-1": "active", "alias-2": "active", "apart": "active"}


def reconciled_facts(spark: SparkSession, rows: list[tuple] = FACT_ROWS) -> DataFrame:
    keyed = facts.topic_keys(spark.createDataFrame(rows, FACTS))
    return facts.reconcile(facts.merged_keys(keyed, facts.alias_pairs(keyed)))


def q_fact_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled_facts(spark).select("id", "status")


def q_fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.conflicts(reconciled_facts(spark)).select("id", "topic", F.array_join("candidate_values", "|").alias("candidate_values"), "safe_answer")


def q_fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled_facts(spark).groupBy("key").agg(F.count("*").alias("facts"))


def _bid(package, role, amendment, modality, channel, scope="whole_bid", condition=None):
    return package, role, amendment, scope, modality, channel, condition


RELATIONS = [
    _bid("unique", "base", None, "required", "email"), _bid("unique", "base", None, "prohibited", "fax"),
    _bid("multiple", "base", None, "required", "email"), _bid("multiple", "base", None, "permitted", "portal"),
    _bid("contradicted", "base", None, "required", "email"), _bid("contradicted", "base", None, "prohibited", "email"),
    _bid("possible", "base", None, "permitted", "courier"),
    _bid("none", "base", None, "prohibited", "fax"),
    _bid("ambiguous", "base", None, "required", "email", "ambiguous"),
    _bid("restated", "base", None, "required", "email"), _bid("restated", "amendment", "001", "required", "email"),
    _bid("weakened", "base", None, "required", "email"), _bid("weakened", "amendment", "001", "permitted", "email"),
    _bid("conditional", "base", None, "required", "email"), _bid("conditional", "base", None, "prohibited", "email", "whole_bid", "c1"),
]
CHANNELS = [("unique", "unique", "email"), ("multiple", "multiple", None), ("contradicted", "contradicted", None), ("possible", "possible_only", None), ("none", "none", None), ("ambiguous", "unresolved", None), ("restated", "unique", "email"), ("weakened", "unresolved", None), ("conditional", "unique", "email")]


def q_channel_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RELATIONS, "package_id string, role string, amendment_number string, subject_scope string, modality string, channel string, condition_sha256 string")
    return coverage.resolve_channels(rows)


MENTION_TEXT = "Bids by e-mail to bids@agency.gc.ca or by electronic mail. Electronic signatures count. Fax and courier are refused; hand delivery in person only."
MENTIONS = [("email", 8, 14), ("email", 18, 35), ("postal_mail", 53, 57), ("electronic", 59, 69), ("fax", 88, 91), ("courier", 96, 103), ("hand_delivery", 117, 130), ("hand_delivery", 131, 140)]


def q_channel_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("d", 1, MENTION_TEXT)], "document_sha256 string, page int, text string")
    return coverage.mentions(rows).select("channel", "start", "end", "core")


CHECKED = [
    ("fine", 10, 60, "whole_bid", "required", "email", None, None, 0.95, None),
    ("outside", 10, 9999, "whole_bid", "required", "email", None, None, 0.95, "offset_mismatch"),
    ("long", 10, 900, "whole_bid", "required", "email", None, None, 0.95, "quote_too_long"),
    ("other core", 2690, 2740, "whole_bid", "required", "email", None, None, 0.95, "ownership_mismatch"),
    ("unsure", 10, 60, "whole_bid", "required", "email", None, None, 0.5, "low_confidence"),
    ("condition", 10, 60, "whole_bid", "required", "email", 50, 70, 0.95, "condition_mismatch"),
    ("half condition", 10, 60, "whole_bid", "required", "email", 50, None, 0.95, "condition_mismatch"),
    ("vague", 10, 60, "ambiguous", "required", "email", None, None, 0.95, "semantic_uncertainty"),
    ("unnamed", 10, 60, "whole_bid", "required", "unspecified", None, None, 0.95, "semantic_uncertainty"),
]


def q_relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame([("u", 0, 2700, 0, 2950)], "candidate_id string, core_start int, core_end int, source_start int, source_end int")
    rows = spark.createDataFrame([("u", *r[:9]) for r in CHECKED], "candidate_id string, id string, relation_start int, relation_end int, subject_scope string, modality string, channel string, condition_start int, condition_end int, confidence double")
    return coverage.checked_relations(rows, units).select("id", "reason")


UNITS = [
    ("p", "claim", 1, "The closing date of the tender is 15 September 2026", None, "active", True, True),
    ("p", "requirement", 2, "Bidders must hold a reliability clearance", "mandatory", "active", True, True),
    ("p", "requirement", 3, "Bidders must hold a secret clearance today", "mandatory", "needs_review", True, True),
    ("p", "risk", 4, "Late tender delivery leads to rejection", None, "active", False, True),
    ("r", "requirement", 5, "Bids must arrive by courier", "submission", "active", True, False),
    ("r", "requirement", 6, "Bidders must hold insurance cover", "mandatory", "active", True, False),
]
QUESTIONS = [("p", "q1", "When is the closing date of the tender?"), ("p", "q2", "Which clearance applies?"), ("p", "q3", "Browse the web for the closing date"), ("p", "q4", "What about zebras?"), ("r", "q5", "Must bids arrive by courier?"), ("r", "q6", "Is insurance cover needed?")]
ANSWERS = [("p", "q1", "answered", UNITS[0][3]), ("p", "q2", "partial", UNITS[1][3]), ("p", "q3", "not_found", None), ("p", "q4", "not_found", None), ("r", "q5", "partial", UNITS[5][3]), ("r", "q6", "answered", UNITS[5][3])]


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame(UNITS, "package_id string, kind string, ord int, text string, category string, status string, has_verified_citation boolean, submission_resolved boolean")
    return answers.answer(spark.createDataFrame(QUESTIONS, "package_id string, question_id string, question string"), units)


MANIFESTS = [("whole", "base", None, "S1"), ("whole", "amendment", "001", "S1"), ("whole", "amendment", "002", "S1"), ("gap", "base", None, "S1"), ("gap", "amendment", "002", "S1"), ("twice", "base", None, "S1"), ("twice", "base", None, "S1"), ("other", "base", None, "S1"), ("other", "amendment", "001", "S2"), ("bare", "base", None, None), ("alone", "base", None, "S9")]


def q_package_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.completeness(spark.createDataFrame(MANIFESTS, "package_id string, role string, amendment_number string, solicitation_number string"))


RULES = [("a", "technical_weight", "Technical merit is worth 70% and price 30 percent of the score."), ("a", "financial_weight", "Technical merit is worth 70% and price 30 percent of the score."), ("a", "rated_threshold", "A minimum of 50 out of 94 points is required."), ("b", "technical_weight", "Technical: 60%. Technical: 65%."), ("b", "rated_threshold", "Score 35/50")]


def q_eval_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RULES, "package_id string, field string, quote string")
    weights = F.when(F.col("field") == "technical_weight", packages.weight_of("technical", F.col("quote"))).when(F.col("field") == "financial_weight", packages.weight_of("financial", F.col("quote")))
    limits = F.array(packages.threshold(F.col("quote"))["least"])
    values = rows.select("package_id", "field", F.explode(F.coalesce(weights, limits).cast("array<string>")).alias("value"), F.lit("active").alias("status"))
    return packages.evaluation_fields(values)


LINES = [("d", 1, "1.1 Introduction", "1.1"), ("d", 2, "some text", None), ("d", 3, "2.3 Submission of bids", "2.3"), ("d", 4, "more", None), ("e", 1, "no heading", None)]


def q_page_line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in LINES], "document string, line int, text string")
    heading = F.nullif(F.regexp_extract("text", r"^(\d+(?:\.\d+)+)" + T.B1, 1), F.lit(""))
    return coverage.sections(rows.withColumn("heading", heading), "document", "line", "heading").select("document", "line", "section")


QUOTE_PAGES = [("d", 1, "The supplier shall deliver the completin g report on time. Shared clause text."), ("d", 2, "Payment is “firm” — fixed price. Shared clause text."), ("e", 1, "Other document. Unique here.")]
QUOTES = [("exact", "d", "Payment is “firm”"), ("plain", "d", 'payment is "firm" - fixed price.'), ("twice", "d", "Shared clause text."), ("short", "d", "ON TIME"), ("mended", "d", "shall deliver the completing report"), ("wrong doc", "e", "Payment is “firm”"), ("empty", "d", " ")]
VERIFIED = [("exact", 2, "exact"), ("plain", 2, "normalized"), ("twice", None, "manual_required"), ("short", None, "manual_required"), ("mended", 1, "normalized"), ("wrong doc", None, "manual_required"), ("empty", None, "manual_required")]


def q_quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = spark.createDataFrame(QUOTE_PAGES, "document_sha256 string, page int, text string")
    candidates = spark.createDataFrame(QUOTES, "candidate_id string, document_sha256 string, evidence_quote string")
    return citations.verify_citations(candidates, pages_).select("candidate_id", "page", "method")


REQUIRED_TEXT = "The Bidder must hold a clearance. Prices are firm for one year. Work shall start in May of that year! Reports are required monthly: The Bidder must sign."


def q_mandatory_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.createDataFrame([("d", 1, REQUIRED_TEXT)], "document_sha256 string, page int, text string")
    return extract.mandatory_requirements(pages.chunks(source)).select("n", "quote")


POLARITY = [("a", "Bids  CAN’T be late", "bids cannot be late"), ("b", "They weren't told", "they were not told"), ("c", "It won't do", "it will not do")]


def q_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in POLARITY], "id string, text string").select("id", T.polarity_text(F.col("text")).alias("plain"))


COVER = """RETURN BIDS TO:
Bid Receiving
REQUEST FOR PROPOSAL
Proposal To: Department of Works
and Services
We hereby offer to sell
Title: Bridge  Repair Works
Solicitation No.: EZ-123/A Date: 2026-01-05"""
SUMMARY = """1.1 Introduction
Text before.
1.2 Summary
The Department needs a contractor for the repair of the northern bridge.
Page 2 of 9
The work includes supply of steel and all site services for one year. It may change later on in this year.
The security requirements are listed elsewhere in this document here.
2 Other matters
The work is not part of the summary anymore in this place."""
CRITERIA = """Mandatory criteria
M1 The Bidder must hold a valid licence for bridge work. Further notes.
M2 The bidder shall propose up to three (3) resources and provide detailed resumes for each resource named.
M1 The Bidder must repeat nothing."""
RULES_PAGE = """4.1 Basis of Selection
4.1.1 Mandatory
A bid must comply with the requirements of the bid solicitation and meet all mandatory technical evaluation criteria to be declared responsive. The responsive bid with the lowest evaluated price will be recommended for award of a contract.
4.2 Next"""
SECURITY_PAGE = """6.1 Security Requirements
1. At the date of closing, the following applies:
The Bidder must hold a valid organization security clearance as
indicated in Part 7.
6.2 Other
The Contractor personnel on site must each hold a valid reliability status granted before.
The security requirements check list, attached at Annex C, applies. ANNEX "D" - SECURITY REQUIREMENTS CHECK LIST"""
PAGES = [("p", "d", "base", None, i, t) for i, t in enumerate((COVER, SUMMARY, CRITERIA, RULES_PAGE, SECURITY_PAGE), 1)]
PAGES += [("q", "e", "base", None, 1, COVER), ("q", "f", "amendment", "001", 1, RULES_PAGE + "\n" + SECURITY_PAGE)]
ANCHORS = [
    ("p", 2, "overview", "The Department needs a contractor for the repair of the northern bridge.", "1.2 Summary"),
    ("p", 2, "scope", "The work includes supply of steel and all site services for one year.", "1.2 Summary"),
    ("p", 1, "title", "Bridge Repair Works", "Cover - Title"),
    ("p", 1, "solicitation_number", "EZ-123/A", "Cover - Solicitation No."),
    ("p", 1, "issuer", "Department of Works and Services", "Cover - Proposal To"),
    ("p", 4, "mandatory_gate", "true", "4.1.1"),
    ("p", 4, "selection_method", "Lowest evaluated price", "4.1.1"),
    ("p", 3, "mandatory", "The Bidder must hold a valid licence for bridge work.", "M1"),
    ("p", 3, "mandatory", "The bidder shall propose up to three (3) resources and provide detailed resumes for each", "M2"),
    ("p", 5, "organization-clearance", "The Bidder must hold a valid organization security clearance as indicated in Part 7.", "6.1"),
    ("p", 5, "checklist_annex", "Annex C", "Security Requirements Checklist"),
    ("p", 5, "checklist_annex", "Annex D", "Security Requirements Checklist"),
    ("q", 1, "checklist_annex", "Annex C", "Security Requirements Checklist"),
    ("q", 1, "checklist_annex", "Annex D", "Security Requirements Checklist"),
]


def q_source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PAGES, "package_id string, document_sha256 string, role string, amendment_number string, page int, text string")
    return anchors.anchors(rows).select("package_id", "page", "kind", "value", "section")


PROSE = [
    ("verbatim", "The contract starts in May", "The contract starts in May. Other text", True),
    ("words", "contractor supplies steel", "The contractor also supplies structural steel", True),
    ("negated", "contractor supplies steel", "The contractor does not supply steel", False),
    ("tentative", "contractor supplies steel", "The contractor may supply steel", False),
    ("left out", "price is firm", "The price is firm at 30 percent", False),
    ("other words", "Fake contract title", "The title is real contract", False),
    ("compared", "cost exceeds estimate", "The estimate exceeds cost", False),
    ("both negative", "bids will not be late", "bids won't be late", True),
]


def q_prose_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in PROSE], "id string, assertion string, quote string")
    spans = rows.select("id", "assertion", F.explode(P.evidence_spans(F.col("quote"))).alias("span"))
    return spans.groupBy("id").agg(F.bool_or(P.span_supports(F.col("assertion"), F.col("span"))).alias("supported"))


ADDRESSES = [("8.8.8.8", True), ("10.1.2.3", False), ("192.0.2.77", False), ("172.32.0.1", True), ("256.1.1.1", False), ("01.2.3.4", False), ("2001:4860:4860::8888", True), ("2001:db8::1", False), ("fe80::1", False), ("::ffff:8.8.8.8", False), ("host", False), (None, False)]


def q_public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(ADDRESSES, "address string, expected boolean").select("address", C.public_address(F.col("address")).alias("public"))


URLS = [("https://files.example.org/a.pdf", True), ("http://files.example.org/a.pdf", False), ("https://u:p@files.example.org/a", False), ("https://files.example.org:443/a", True), ("https://files.example.org:8443/a", False), ("https://other.example.org/", False), ("not a url", False)]


def q_allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(URLS, "url string, expected boolean").select("url", C.allowed_url(F.col("url"), "files.example.org").alias("allowed"))


HEADINGS = [("a", "Solicitation No.: EZ899-24/B Amendment No. 2", "002", "EZ899-24/B"), ("b", "Revision 12 of the tender", "012", None), ("c", "no number", None, None)]


def q_heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in HEADINGS], "id string, heading string")
    return rows.select("id", C.amendment_in(F.col("heading")).alias("amendment"), C.solicitation_in(F.col("heading")).alias("solicitation"))


BEATS = [("fresh", "2026-01-01 00:00:00", 100, 45000, "fresh"), ("old", "2025-12-31 23:40:00", 100, 45000, "stale"), ("ahead", "2026-01-01 00:10:00", 100, 45000, "stale"), ("slow", "2026-01-01 00:00:00", 46000, 45000, "stale"), ("none", None, None, None, "missing")]


def q_heartbeat_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in BEATS], "id string, at string, duration int, budget int")
    status = C.heartbeat_status(F.col("at").cast("timestamp"), F.col("duration"), F.col("budget"), F.lit("2026-01-01 00:05:00"))
    return rows.select("id", status.alias("status"))


METHOD_TEXTS = [("a", "lowest evaluated total price", "lowest_evaluated_price"), ("b", "the lowest price", "lowest_price"), ("c", "best value and highest score", None), ("d", "Highest  Combined Rating", "highest_combined_rating"), ("e", "none", None)]


def q_selection_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in METHOD_TEXTS], "id string, text string").select("id", P.selection_method(F.col("text")).alias("method"))


#: The published estimates for one document without a bucket and five with one; they add up to 876,121 and 894,623.
PLATFORM = [("platform", "compute", 736251), ("platform", "events", 25000), ("platform", "data_written", 40960), ("platform", "data_retained", 10923), ("platform", "queue", 12000)]
ESTIMATES = [("r1", *r) for r in [*PLATFORM, ("database", "postgres", 50987)]] + [("r5", *r) for r in [*PLATFORM, ("database", "postgres", 69487), ("bucket", "storage", 2)]]


def q_infrastructure_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.infrastructure_costs(spark.createDataFrame([("r1", 1, 1.0, 24, False), ("r5", 5, 1.0, 24, True)], "run_id string, documents int, database_units double, ttl_hours int, bucket boolean"))


DRAFT_PAGES = [("d", 1, "The bidder must provide a signed form by 2026-05-01. The contract value is at most 500 CAD."), ("d", 2, "Work may start in June. The mandatory requirements are listed in annex B."), ("d", 3, "Nothing here.")]
#: id, kind, text, category, document, quotes, why it does not stand
DRAFTS = [
    ("good", "claim", "The contract value is at most 500 CAD", None, "d", ["The contract value is at most 500 CAD."], None),
    ("must", "requirement", "The bidder must provide a signed form", "mandatory", "d", ["The bidder must provide a signed form by 2026-05-01."], "unsupported_statement"),
    ("dated", "requirement", "The bidder must provide a signed form by 2026-05-01", "mandatory", "d", ["The bidder must provide a signed form by 2026-05-01."], None),
    ("altered", "claim", "The contract value is at most 600 CAD", None, "d", ["The contract value is at most 500 CAD."], "unsupported_value"),
    ("firm", "claim", "Work starts in June", None, "d", ["Work may start in June."], "unsupported_statement"),
    ("pointer", "requirement", "The mandatory requirements are listed in annex B", "mandatory", "d", ["The mandatory requirements are listed in annex B."], "unsupported_mandatory"),
    ("lost", "claim", "Work may start in June", None, "d", ["Work may begin in June."], "unverified_citation"),
    ("bare", "claim", "Work may start in June", None, "d", [], "no_citation"),
    ("stranger", "claim", "Work may start in June", None, "x", ["Work may start in June."], "unknown_document"),
    ("twice", "claim", "Work may start in June", None, "d", ["Work may start in June."], "duplicate_id"),
    ("twice", "claim", "The contract value is at most 500 CAD", None, "d", [], "duplicate_id"),
]


def judged_drafts(spark: SparkSession) -> DataFrame:
    pages_ = spark.createDataFrame(DRAFT_PAGES, "document_sha256 string, page int, text string")
    records_ = spark.createDataFrame([("p", k, i, t, c, d) for i, k, t, c, d, _, _ in DRAFTS], "package_id string, kind string, id string, text string, category string, document_sha256 string")
    quotes = spark.createDataFrame([("p", k, i, n, d, q) for i, k, _, _, d, qs, _ in DRAFTS for n, q in enumerate(qs)], "package_id string, kind string, id string, ordinal int, document_sha256 string, evidence_quote string")
    manifests = spark.createDataFrame([("p", "d")], "package_id string, document_sha256 string")
    return materialize.judged_records(records_, materialize.verified_citations(quotes, pages_), manifests)


def q_judged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_drafts(spark).select("id", "text", "reason", "status")


def q_package_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = spark.createDataFrame([("p", 3)], "package_id string, pages_total int")
    fields = spark.createDataFrame([("p", 2)], "package_id string, fields int")
    return materialize.package_quality(judged_drafts(spark), totals, fields)


QUERIES = {f.__name__: f for f in (q_assertion_tokens, q_token_support, q_fact_statuses, q_fact_conflicts, q_fact_groups, q_channel_resolution, q_channel_mentions, q_relation_checks, q_answers, q_package_completeness, q_eval_pivot, q_page_line_sections, q_quote_verification, q_mandatory_requirements, q_polarity, q_source_anchors, q_prose_support, q_public_addresses, q_allowed_urls, q_heading_numbers, q_heartbeat_status, q_selection_methods, q_infrastructure_costs, q_judged_records, q_package_quality)}

SQL = {
    "q_assertion_tokens": _values("id, tokens", [(i, " ".join(t)) for i, _, t in ASSERTIONS]),
    "q_token_support": _values("id, supported", [(r[0], r[3]) for r in SUPPORT]),
    "q_fact_statuses": _values("id, status", list(STATUS.items())),
    "q_fact_conflicts": _values("id, topic, candidate_values, safe_answer", [("conflict-owned-horizon", "projection horizon", "2050|2055", "The supplied amendment is internally inconsistent; clarification is required.")]),
    "q_fact_groups": _values("key, facts", [("owned:closing", 2), ("owned:payment", 2), ("owned:horizon", 4), ("owned:insurance", 1), ("owned:security", 1), ("final:limit:page:report", 2), ("annex:interim:limit:report", 1)]),
    "q_channel_resolution": _values("package_id, status, channel", CHANNELS),
    "q_channel_mentions": _values('channel, "start", "end", core', [(*m, 0) for m in MENTIONS]),
    "q_relation_checks": _values("id, reason", [(r[0], r[9]) for r in CHECKED]),
    "q_answers": _values("package_id, question_id, answerability, answer", ANSWERS),
    "q_package_completeness": _values("package_id, completeness", [("whole", "unverified"), ("gap", "incomplete"), ("twice", "incomplete"), ("other", "incomplete"), ("bare", "incomplete"), ("alone", "unverified")]),
    "q_eval_pivot": _values("package_id, mandatory_gate, rated_threshold, technical_weight, financial_weight, selection_method", [("a", None, "50.0", "70.0", "30.0", None), ("b", None, "35.0", None, None, None)]),
    "q_page_line_sections": _values("document, line, section", [("d", 1, "1.1"), ("d", 2, "1.1"), ("d", 3, "2.3"), ("d", 4, "2.3"), ("e", 1, None)]),
    "q_quote_verification": _values("candidate_id, page, method", VERIFIED),
    "q_mandatory_requirements": _values("n, quote", [(1, "The Bidder must hold a clearance."), (2, "Work shall start in May of that year!"), (3, "Reports are required monthly:")]),
    "q_source_anchors": _values("package_id, page, kind, value, section", ANCHORS),
    "q_prose_support": _values("id, supported", [(r[0], r[3]) for r in PROSE]),
    "q_public_addresses": _values("address, public", ADDRESSES),
    "q_allowed_urls": _values("url, allowed", URLS),
    "q_heading_numbers": _values("id, amendment, solicitation", [(r[0], r[2], r[3]) for r in HEADINGS]),
    "q_heartbeat_status": _values("id, status", [(r[0], r[4]) for r in BEATS]),
    "q_selection_methods": _values("id, method", [(r[0], r[2]) for r in METHOD_TEXTS]),
    "q_infrastructure_costs": _values("run_id, provider, operation, estimated_micro_usd", ESTIMATES),
    "q_judged_records": _values("id, text, reason, status", [(r[0], r[2], r[6], "needs_review" if r[6] else "active") for r in DRAFTS]),
    "q_package_quality": _values('package_id, active, "open", verified_citations, covered_pages, pages_total, readiness', [("p", 2, 9, 2, 1, 3, "needs_clarification")]),
    "q_polarity": _values("id, plain", [(r[0], r[2]) for r in POLARITY]),
}
