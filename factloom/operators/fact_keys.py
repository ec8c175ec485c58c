"""Which closed key a fact has, as its verified source says it, and what risks depend on facts that no longer hold.

A key is read from a segment of the source that supports the fact's value; neither topic nor value can make one.
Facts have package_id, id, topic, value and document_sha256; citations have the two ids, document_sha256, evidence_quote and
verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import B0, B1, normalised, polarity_text, significant_words
from factloom.functions.tokens import assertion_tokens
from factloom.sources.staging import stage

from .cases import cases

FACT = ["package_id", "id"]

# Where a segment of a source ends, and the objects at which a list about insurance is cut.
SENTENCE_END = r"(?<!a\.m)(?<!p\.m)\.\s+|[;\n]+"
SEGMENT_END = rf"{SENTENCE_END}|{B0}(?:while|whereas|but|although|yet){B1}"
OBJECTS = "contact|representative|attention|deductible|certificate|certification|coverage|limit|amount|liability|premium|fee|cost|payment|invoice|price|claim"
LIST_CUT = rf"(?:,\s*|\s+){B0}and\s+(?=(?:insurance\s+)?(?:coverage\s+)?(?:{OBJECTS}){B1})|,\s*(?=(?:insurance\s+)?(?:coverage\s+)?(?:{OBJECTS}){B1})"
OBJECT_FIRST = rf"^(?:coverage\s+)?(?:{OBJECTS}){B1}"
DEADLINE_CUT = rf"{B0}(?:while|whereas|but|although|yet){B1}|(?:,\s*|\s+and\s+|\s+(?:(?:together|along)\s+)?with\s+|\s+as\s+well\s+as\s+|\s*-\s*|:\s*|\(\s*)(?=(?:(?:while|whereas|but|and|although|yet|with)\s+)?(?:the\s+)?(?:(?:all|written|bidder|vendor|supplier|offeror|prospective)\s+)*(?:solicitation|bids?|proposals?|tenders?|offers?|submissions?|questions?|enquir(?:y|ies)|clarifications?|q\s*(?:&|and)\s*a){B1})"

# The keys by the wording of a segment. The first row that applies decides: its words are all in the
# segment (or, where marked so, in segment and value together), and none of the excluded words is. No key means none.
INSURANCE = "insurance|commercial general liability|professional liability|errors and omissions|e\\s*&\\s*o|cgl"
PROFESSIONAL, GENERAL = "professional liability|errors and omissions|e\\s*&\\s*o", "commercial general liability|cgl"
COVERAGE = "coverage|policy limit|insured amount|liability coverage"
PAYMENT_DETAIL = "currency|frequenc(?:y|ies)|rate|unit price|invoice|billing|tax|expense|travel"
KEYS = [
    # key, words of the segment, words of segment and value, excluded from the segment, excluded from both
    ("document:security-requirements-checklist:annex", ["security requirements? check\\s*list", "annex\\s*[\"']?\\s*[a-z]"], [], None, None),
    ("document:basis-of-payment:payment-currency", ["basis of payment"], ["(?:payment )?currenc(?:y|ies)"], None, None),
    ("document:basis-of-payment:invoice-frequency", ["basis of payment"], ["(?:invoice|billing|payment) frequenc(?:y|ies)"], None, None),
    ("document:basis-of-payment", ["basis of payment", "in its entirety|entire(?:ty)?|whole|complete(?:ly)?"], [], None, None),
    ("document:basis-of-payment", ["basis of payment"], [], None, PAYMENT_DETAIL),
    (None, ["basis of payment"], [], None, None),
    ("document:m3-appendix-1", ["appendix\\s*1|criterion\\s*m3|m3", "compliance table|essential requirements|appendix"], [], None, None),
    ("insurance:contact", [INSURANCE, "contact|representative|attention"], [], None, None),
    ("insurance:deductible", [INSURANCE, "deductible"], [], None, None),
    ("insurance:certificate", [INSURANCE, "certificat(?:e|ion)"], [], None, None),
    (None, [INSURANCE, "premium|fee|claim amount|claim value|claim cost|cost|payment|invoice|price"], [], COVERAGE, None),
    (None, [PROFESSIONAL, GENERAL], [], None, None),
    ("insurance:professional-liability:coverage", [PROFESSIONAL], [], None, None),
    ("insurance:cgl:coverage", [GENERAL], [], None, None),
    ("insurance:coverage", [INSURANCE, f"{COVERAGE}|insurance limit|insurance amount"], [], None, None),
    ("contract:end", ["contract", "end date|expiry(?: date)?|expiration(?: date)?|termination date|period ends?|contract term"], [], "(?:termination|contract)\\s+(?:fee|notice|right|clause|cost|payment|damages?)", None),
    ("projection:horizon", ["projection|projections|forecast|forecasts", "horizon|end year|endpoint|projection period|forecast period|years? (?:out|beyond)"], [], "payment|invoice|contract|service term|delivery|fee|price|cost", None),
]
ROW = rf"{B0}(?:row|item|criterion)\s*(?:m3[.:-]?)?0*(\d{{1,3}}){B1}"
# The wording of the two deadlines, and of a change's new value.
QUESTIONS = r"(?:questions?|enquir(?:y|ies)|clarifications?|requests? for clarification|q\s*(?:&|and)\s*a|question(?:s)?[- ]and[- ]answer(?:s)?)"
QUESTION_SCOPE = rf"{B0}{QUESTIONS}\s+(?:(?:must|shall)\s+be\s+|(?:is|are)\s+)?(?:close(?:s|d)?|closing|cut[ -]?off|deadline|due|received|submitted){B1}|{B0}{QUESTIONS}\s+(?:closing (?:date|time)|cut[ -]?off|deadline|due date){B1}|{B0}(?:closing (?:date|time)|cut[ -]?off|deadline)\s+(?:for|to)\s+(?:submitting\s+)?{QUESTIONS}{B1}"
CLOSING_SCOPE = rf"{B0}(?:closing date|closing time|submission deadline|submission date|bid deadline|tender deadline|solicitation deadline){B1}|{B0}(?:solicitation|bid|bids|proposal|proposals|tender|offer|offers|submission)\s+(?:(?:must|shall)\s+be\s+|(?:is|are)\s+)?(?:received|submitted|due|close(?:s|d)?|closing){B1}|{B0}(?:deadline|closing (?:date|time)|due date)\s+(?:for|to)\s+(?:submitting\s+)?(?:bids?|proposals?|tenders?|offers?|submissions?){B1}|{B0}(?:late bids?|bids? received after|submissions? after|submit before){B1}"
CHANGED_TO = rf"(?:amend(?:ed|s)?|chang(?:e|ed|es)|extend(?:ed|s)?|revis(?:e|ed|es)|updat(?:e|ed|es)){B1}[^.;]{{0,100}}?{B0}(?:to|until|through|into)|(?:replac(?:e|ed|es)|substitut(?:e|ed|es)){B1}[^.;]{{0,100}}?{B0}(?:to|with|by)|(?:increas(?:e|ed|es)|decreas(?:e|ed|es)|rais(?:e|ed|es)|reduc(?:e|ed|es)|restor(?:e|ed|es)){B1}[^.;]{{0,100}}?{B0}(?:to|into)"
NEW_VALUE = (
    rf"{B0}new\s+(?:value|limit|amount|date|time|deadline|ratio|weight|requirement)\s*(?:is|:|=)\s*(.+)$",
    rf"{B0}(?:amended|revised|updated|replacement)\s+[a-z][a-z0-9&/()' -]{{0,60}}\s+(?:is|are|equals?)\s+(.+)$",
    rf"{B0}now{B1}\s*:?[\s-]+(.+)$",
)
OLD_VALUE = rf"(?:,\s*|\s+|\(\s*)(?:and\s+)?(?:not|rather than|instead of|except(?: for)?|from|previously|formerly|old(?: value| limit| amount| date| time)?|prior(?: value| limit| amount| date| time)?|equivalent reference|reference(?: value| amount| only)?){B1}"
# The wording of risks; every row that applies gives its key.
TIMING = "close(?:s|d)?|closing|cut[ -]?off|deadline|due|received|submit(?:ted|ting|s)?|before|after|late|reject(?:ed|ion)?|non-compliant|noncompliant"
ASKED, BID = r"questions?|enquir(?:y|ies)|clarifications?|q\s*(?:&|and)\s*a", "solicitation|bids?|proposals?|tenders?|offers?|submissions?|closing (?:date|time)|late bids?"
BARE_DEADLINE = "deadline|cut[ -]?off|closing (?:date|time)"
INSURED, DETAIL = r"insurance|insured|commercial general liability|professional liability|errors and omissions|e\s*&\s*o|cgl", "contact|representative|attention|deductible|certificat(?:e|ion)"
LIMIT = r"coverage|policy\s+limit|coverage\s+limit|insured\s+amount|liability\s+coverage"
RISK_KEYS = [
    # key, words, excluded
    ("deadline:questions", [ASKED, TIMING], None),
    ("deadline:solicitation", [BID, TIMING], None),
    ("deadline:questions", [BARE_DEADLINE], f"{ASKED}|{BID}"),
    ("deadline:solicitation", [BARE_DEADLINE], f"{ASKED}|{BID}"),
    ("insurance:coverage", [r"claim\b.{0,60}\b(?:exceeds?|above|greater than)\b.{0,60}\b(?:available\s+)?protection"], None),
    ("insurance:contact", [INSURED, "contact|representative|attention"], None),
    ("insurance:deductible", [INSURED, "deductible"], None),
    ("insurance:certificate", [INSURED, "certificat(?:e|ion)"], None),
    ("insurance:professional-liability:coverage", [PROFESSIONAL], None),
    ("insurance:cgl:coverage", [GENERAL], None),
    ("insurance:coverage", [rf"(?:insurance|insured)\b.{{0,60}}\b(?:{LIMIT})|(?:{LIMIT})\b.{{0,60}}\b(?:insurance|insured)"], f"{PROFESSIONAL}|{GENERAL}|{DETAIL}"),
    ("contract:end", ["contract", "end date|expiry|expiration|terminat(?:e|ion)|period ends?|contract term"], None),
    ("projection:horizon", ["projection|projections|forecast|forecasts", r"horizon|end year|endpoint|extend|through|until|years? (?:out|beyond)|to 20\d{2}"], None),
]
# Words of dates, zones and currencies, which relate nothing.
SCALAR_WORDS = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday mdt mst edt est cdt cst pdt pst utc gmt cad usd eur gbp".split()
TEMPORAL = ("date:", "time:", "timezone:", "utc-offset:")


def _has(text: Column, words: str) -> Column:
    return text.rlike(f"{B0}(?:{words}){B1}")


def segments(plain: Column) -> Column:
    """A quote in the form of evidence, in segments that each relate one thing; the objects of a list about insurance are cut apart."""
    insured = _has(plain, "insurance")
    parts = F.when(insured, F.split(plain, f"{SEGMENT_END}|{LIST_CUT}")).otherwise(F.split(plain, SEGMENT_END))
    named = F.transform(parts, lambda p: F.when(insured & ~_has(p, "insurance") & F.trim(p).rlike(OBJECT_FIRST), F.concat(F.lit("insurance "), F.trim(p))).otherwise(F.trim(p)))
    return F.filter(named, lambda p: p != "")


def deadline_segments(quote: Column, compose: bool = True) -> Column:
    """A quote in clauses, each about one deadline at most."""
    return F.filter(F.transform(F.split(normalised(quote, compose), f"{SENTENCE_END}|{DEADLINE_CUT}"), lambda p: F.trim(p)), lambda p: p != "")


def supports_value(segment: Column, plain: Column) -> Column:
    """Whether a segment has a value, both in the form of evidence: as it stands, or all its tokens and words."""
    asserted, words = assertion_tokens(plain, False), significant_words(plain)
    tokens = F.size(F.array_except(asserted, assertion_tokens(segment, False))) == 0
    said = F.when(F.size(words) == 0, F.size(asserted) > 0).otherwise(F.size(F.array_except(words, significant_words(segment))) == 0)
    return ((F.length(plain) >= 3) & F.contains(segment, plain)) | (tokens & said)


def segment_key(segment: Column, plain: Column) -> Column:
    """The key of a segment by the table above, with the row of an appendix; null if it has none."""
    both = F.concat(segment, F.lit(" "), plain)
    case = None
    for key, words, shared, none_of, none_of_both in KEYS:
        test = F.lit(True)
        for pattern in words:
            test &= _has(segment, pattern)
        for pattern in shared:
            test &= _has(both, pattern)
        if none_of:
            test &= ~_has(segment, none_of)
        if none_of_both:
            test &= ~_has(both, none_of_both)
        case = (F if case is None else case).when(test, F.lit(key))
    row = F.regexp_extract(both, ROW, 1)
    return F.when((case == "document:m3-appendix-1") & (row != ""), F.concat(case, F.lit(":row:"), F.lpad(row, 2, "0"))).otherwise(case)


def once(rows: DataFrame, texts: list[str], **made: Column) -> DataFrame:
    """The rows with columns made of these texts, once for each distinct combination; rows with a null text get nulls."""
    known = stage(rows.select(*texts).distinct().withColumns(made), "distinct")
    return rows.join(known, texts, "left")


def _own_citations(facts: DataFrame, citations: DataFrame) -> DataFrame:
    proof = citations.filter("verified").select(*FACT, F.lower("document_sha256").alias("_cited"), "evidence_quote")
    return facts.select(*FACT, "topic", "value", "document_sha256").join(proof, FACT).filter(F.col("_cited") == F.lower("document_sha256"))


def source_keys(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, source_key): the one key of all segments that support the value; facts without one key are left out.

    A topic of a row or table needs a segment on that appendix. Facts with the same texts are judged as one case.
    """
    proof = _own_citations(facts, citations).select(*FACT, "evidence_quote").distinct()
    members, each, shown = cases(facts.join(proof.select(*FACT).distinct(), FACT, "left_semi"), FACT, ["topic", "value"], proof, ["evidence_quote"])
    judged = stage(_judged_sources(*_of_one_document(each, shown), compose), "judged")
    return members.join(judged.select(F.col("id").alias("_case"), "source_key"), "_case").select(*FACT, "source_key")


def _of_one_document(each: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases, and their proof as verified citations of the document that they come from."""
    return each.withColumn("document_sha256", F.lit("")), shown.withColumns({"document_sha256": F.lit(""), "verified": F.lit(True)})


def _judged_sources(facts: DataFrame, citations: DataFrame, compose: bool) -> DataFrame:
    plain = _own_citations(facts, citations).select(*FACT, *[normalised(F.col(c), compose).alias("_" + c) for c in ("topic", "value", "evidence_quote")])
    # Spark takes no Python function into the functions on arrays below, so composed texts are written first.
    plain = stage(plain, "evidence") if compose else plain
    cut = plain.select(*FACT, "_topic", "_value", F.explode(segments(F.col("_evidence_quote"))).alias("_segment"))
    segment = F.col("_segment")
    tabular = _has(segment, "appendix\\s*1|criterion\\s*m3|m3") & _has(segment, "table|appendix")
    keyed = once(cut, ["_value", "_segment"], _tabular=tabular, _key=F.when(supports_value(segment, F.col("_value")), segment_key(segment, F.col("_value"))))
    sums = keyed.groupBy(FACT).agg(F.collect_set("_key").alias("_keys"), (~F.bool_or(_has(F.col("_topic"), "row|table")) | F.bool_or("_tabular")).alias("_fits"))
    return sums.filter(F.col("_fits") & (F.size("_keys") == 1)).select(*FACT, F.element_at("_keys", 1).alias("source_key"))


def deadline_scope(plain: Column) -> Column:
    """The deadline that a text, in the form of evidence, is about; that for questions first."""
    return F.when(plain.rlike(QUESTION_SCOPE), "deadline:questions").when(plain.rlike(CLOSING_SCOPE), "deadline:solicitation")


def mutation_target(scope: Column) -> Column:
    """What a change, in polarity form, changes to: the text after its last "to" or "with", or after a label of the new value, up to where the old one is spoken of; null if there is none."""
    last = F.regexp_extract(scope, rf"^.*{B0}(?:{CHANGED_TO}){B1}\s*:?[\s-]*(.*)$", 1)
    found = F.coalesce(F.nullif(last, F.lit("")), *[F.nullif(F.regexp_extract(scope, p, 1), F.lit("")) for p in NEW_VALUE])
    return F.nullif(F.trim(F.element_at(F.split(found, OLD_VALUE), 1)), F.lit(""))


def _of_kinds(tokens: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: t.rlike("^(?:" + "|".join(kinds) + ")"))


def deadline_keys(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, deadline_key): the one deadline of all clauses with all the value's tokens; facts without one are left out.

    A clause with several dates, times or zones counts only if it goes from one to another and the value is the other. Facts
    with the same texts are judged as one case.
    """
    proof = citations.filter("verified").select(*FACT, "evidence_quote").distinct()
    members, each, shown = cases(facts.join(proof.select(*FACT).distinct(), FACT, "left_semi"), FACT, ["value"], proof, ["evidence_quote"])
    judged = stage(_judged_deadlines(each, shown.withColumn("verified", F.lit(True)), compose), "judged")
    return members.join(judged.select(F.col("id").alias("_case"), "deadline_key"), "_case").select(*FACT, "deadline_key")


def _judged_deadlines(facts: DataFrame, citations: DataFrame, compose: bool) -> DataFrame:
    cut = citations.filter("verified").join(facts.select(*FACT, "value"), FACT).select(*FACT, normalised(F.col("value"), compose).alias("_value"), F.explode(deadline_segments(F.col("evidence_quote"), compose)).alias("_clause"))
    scoped = cut.withColumns({"_scope": deadline_scope(F.col("_clause")), "_own": deadline_scope(F.col("_value"))}).filter("_scope IS NOT NULL AND (_own IS NULL OR _own = _scope)")
    # Written, so that tokens are made once and not in each test below.
    marked = stage(scoped.withColumns({"_asserted": assertion_tokens(F.col("_value"), False), "_shown": assertion_tokens(F.col("_clause"), False)}), "clauses")
    marked = marked.filter("size(_asserted) > 0").filter(F.size(F.array_except("_asserted", "_shown")) == 0)
    several = F.lit(False)
    for kind in TEMPORAL:
        several |= F.size(_of_kinds(F.col("_shown"), (kind,))) > 1
    # Only clauses that go from one to another need their target, which is written for the same reason.
    spoken = polarity_text(F.col("_clause"), False)
    moved = marked.filter(several & F.col("_clause").rlike(rf"{B0}from{B1}.+{B0}(?:to|until|through){B1}"))
    moved = stage(moved.select(*FACT, "_scope", _of_kinds(F.col("_asserted"), TEMPORAL).alias("_asserted"), F.coalesce(mutation_target(spoken), spoken).alias("_target")), "targets")
    bound = (F.size("_asserted") > 0) & (F.size(F.array_except(F.col("_asserted"), assertion_tokens(F.col("_target"), False))) == 0)
    kept = marked.filter(~several).select(*FACT, "_scope").unionByName(moved.filter(bound).select(*FACT, "_scope"))
    return kept.groupBy(FACT).agg(F.collect_set("_scope").alias("_scopes")).filter("size(_scopes) = 1").select(*FACT, F.element_at("_scopes", 1).alias("deadline_key"))


def same_deadline(asserted: Column, source: Column) -> Column:
    """Whether the tokens of a deadline are the source's: the same dates and times, and the same offsets where the source has any."""
    same = lambda kind: F.array_sort(_of_kinds(asserted, (kind,))) == F.array_sort(_of_kinds(source, (kind,)))
    dated = F.size(_of_kinds(asserted, ("date:",))) > 0
    return dated & same("date:") & same("time:") & ((F.size(_of_kinds(source, ("utc-offset:",))) == 0) | same("utc-offset:"))


def closed_keys(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """Facts with ``fact_key``: as given, or else their deadline, or else their source key, or null."""
    joined = facts.join(deadline_keys(facts, citations, compose), FACT, "left").join(source_keys(facts, citations, compose), FACT, "left")
    return joined.withColumn("fact_key", F.coalesce("fact_key", "deadline_key", "source_key")).drop("deadline_key", "source_key")


def risk_keys(segment: Column) -> Column:
    """All keys that a segment of a risk speaks of."""
    tests = []
    for key, words, none_of in RISK_KEYS:
        test = F.lit(True)
        for pattern in words:
            test &= _has(segment, pattern)
        tests.append(F.when(test & ~_has(segment, none_of) if none_of else test, key))
    return F.array_distinct(F.array_compact(F.array(*tests)))


def risk_lineage(findings: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """Findings (package_id, id, value, document_sha256) with ``lineage`` (bound, ambiguous, unbound) and ``keys``, those of their segments.

    Each segment of a finding needs a span of verified evidence that has all its words but those of dates, zones and currencies,
    and one such word at least; without it the finding is unbound. A segment's source key is read from the evidence.
    Findings with the same texts are judged as one case.
    """
    proof = _own_citations(findings.withColumn("topic", F.lit("")), citations).select(*FACT, "evidence_quote").distinct()
    members, each, shown = cases(findings, FACT, ["value"], proof, ["evidence_quote"])
    judged = stage(judged_lineage(*_of_one_document(each, shown), compose), "judged")
    known = members.join(judged.select(F.col("id").alias("_case"), "lineage", "keys"), "_case").drop("_case")
    joined = findings.join(known, FACT, "left")
    return joined.withColumns({"lineage": F.coalesce("lineage", F.lit("unbound")), "keys": F.coalesce("keys", F.array().cast("array<string>"))})


def judged_lineage(findings: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """The same for findings that are cases already."""
    named = findings.withColumn("topic", F.lit(""))
    spans = lambda c: F.filter(F.transform(F.split(normalised(c, compose), SEGMENT_END), lambda p: F.trim(p)), lambda p: p != "")
    said = named.select(*FACT, "document_sha256", F.explode(spans(F.col("value"))).alias("_said")).distinct()
    shown = _own_citations(named, citations).select(*FACT, F.explode(spans(F.col("evidence_quote"))).alias("_shown"))
    words = F.array_except(significant_words(F.col("_said")), F.array(*map(F.lit, SCALAR_WORDS)))
    backs = (F.size(words) > 0) & (F.size(F.array_except(words, significant_words(F.col("_shown")))) == 0)
    backed = said.join(shown, FACT, "left").groupBy(*FACT, "_said").agg(F.coalesce(F.bool_or(backs), F.lit(False)).alias("_backed"))
    own = F.struct("id", "_said")
    of_spans = said.select("package_id", own.alias("id"), F.lit("").alias("topic"), F.col("_said").alias("value"), "document_sha256")
    proof = citations.join(said.select(*FACT, "_said"), FACT).select("package_id", own.alias("id"), "document_sha256", "evidence_quote", "verified")
    read = _judged_sources(of_spans, proof, compose).select("package_id", "id.id", F.col("id._said").alias("_said"), "source_key")
    keyed = backed.join(read, [*FACT, "_said"], "left").withColumn("_keys", F.array_union(risk_keys(F.col("_said")), F.array_compact(F.array("source_key"))))
    sums = keyed.groupBy(FACT).agg(F.bool_and("_backed").alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_keys")))).alias("_found"))
    joined = findings.join(sums, FACT, "left")
    n = F.when(F.col("_all"), F.size("_found")).otherwise(0)
    lineage = F.when(n == 1, "bound").when(n > 1, "ambiguous").otherwise("unbound")
    return joined.withColumns({"lineage": F.coalesce(lineage, F.lit("unbound")), "keys": F.when(n > 0, F.col("_found")).otherwise(F.array().cast("array<string>"))}).drop("_all", "_found")


def stale_risks(risks: DataFrame, facts: DataFrame, compose: bool = True) -> DataFrame:
    """Risks (as risk_lineage gives them) with ``dependency``: stale if they repeat a token of a superseded fact of their key that no active fact of it has, ambiguous if it is one of several keys, else null.

    Superseded facts of a key with a conflict do not count.
    """
    told = once(facts.filter("fact_key IS NOT NULL"), ["value"], _tokens=assertion_tokens(F.col("value"), compose))
    tokens = told.select("package_id", "fact_key", "status", F.explode("_tokens").alias("token"))
    is_ = lambda status: F.bool_or(F.col("status") == status)
    disputed = facts.filter("status = 'conflicted'").select("package_id", "fact_key").distinct()
    gone = tokens.groupBy("package_id", "fact_key", "token").agg(is_("superseded").alias("_old"), is_("active").alias("_new")).filter("_old AND NOT _new").join(disputed, ["package_id", "fact_key"], "left_anti")
    told = once(risks.filter("lineage != 'unbound'"), ["value"], _tokens=assertion_tokens(F.col("value"), compose))
    asked = told.select(*FACT, "lineage", F.explode("keys").alias("fact_key"), "_tokens")
    met = asked.select(*FACT, "lineage", "fact_key", F.explode("_tokens").alias("token")).join(gone.select("package_id", "fact_key", "token"), ["package_id", "fact_key", "token"])
    found = met.groupBy(FACT).agg(F.when(F.bool_or(F.col("lineage") == "bound"), "stale").otherwise("ambiguous").alias("dependency"))
    return risks.join(found, FACT, "left")
