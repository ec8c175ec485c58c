"""Which changes of facts their sources authorise.

A fact with effect replace or delete may put an earlier one out of force only if verified evidence of its own amendment
says so: a clause affirms the change (it is neither negated, conditional, proposed nor rescinded), the clause is about the
fact's key and goes to the fact's value, the last change that the evidence names goes to that value too, and an
earlier fact of the key exists.

Facts have package_id, id, fact_key, value, effect, stage and document_sha256; citations have the two ids, an ordinal
``citation``, document_sha256, page, evidence_quote and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import B0, B1, normalised, polarity_text
from factloom.functions.tokens import assertion_tokens
from factloom.sources.staging import stage

from .cases import cases
from .fact_keys import FACT, OBJECT_FIRST, OBJECTS, SENTENCE_END, deadline_scope, mutation_target, segment_key, supports_value

#: Kinds of tokens of which a change that names several has to be told in full.
TUPLES = ("number:", "percent:", "currency:", "magnitude:", "date:", "time:", "timezone:", "utc-offset:", "bound:")

# The verbs of a change, and the wordings that affirm one or keep it from being affirmed.
DONE = "amend(?:ed)?|chang(?:e|ed)|delet(?:e|ed)|extend(?:ed)?|remov(?:e|ed)|replac(?:e|ed)|revis(?:e|ed)|substitut(?:e|ed)|supersed(?:e|ed)|updat(?:e|ed)|increas(?:e|ed)|decreas(?:e|ed)|rais(?:e|ed)|reduc(?:e|ed)"
TO_DO = "amend|change|delete|extend|remove|replace|revise|substitute|supersede|update|increase|decrease|raise|reduce"
REPLACES = "amend(?:ed|s)?|replace(?:s|d)?|substitut(?:e|ed|es)|revis(?:e|ed|es)|chang(?:e|ed|es)|extend(?:s|ed)?|updat(?:e|ed|es)|supersed(?:e|ed|es)|increas(?:e|ed|es)|decreas(?:e|ed|es)|rais(?:e|ed|es)|reduc(?:e|ed|es)"
DELETES = "delete(?:d|s)?|remove(?:d|s)?|strike|stricken|cancel(?:led|ed|s)?|no longer applies"
RESCINDED = rf"{B0}(?:this|that|the)\s+(?:change|amendment|revision|replacement|update|extension|deletion){B1}.{{0,80}}{B0}(?:withdrawn|revoked|rescinded|rejected|declined|cancelled|canceled|void|not approved){B1}|{B0}(?:deleted|removed|no longer applies){B1}.{{0,120}}{B0}(?:reinstated|restored|revived|reapplied){B1}"
UNSETTLED = [
    rf"{B0}(?:may|might|can|could|would|should){B1}.{{0,45}}{B0}(?:{TO_DO})",
    rf"{B0}(?:is|are|was|were)\s+(?:expected|anticipated|proposed|recommended|planned|intended|considered)\s+to{B1}",
    rf"{B0}it\s+(?:is|was)\s+(?:possible|expected|anticipated){B1}",
    rf"{B0}(?:draft|proposed)\s+amendment{B1}",
    rf"{B0}according to\s+(?:a|the)\s+(?:draft|proposal|recommendation){B1}",
    rf"{B0}(?:option|alternative)\s*:",
    rf"{B0}(?:proposal|recommendation|request|option){B1}.{{0,40}}{B0}(?:states?|says?|provides?|asserts?|indicates?|to|would|could){B1}",
    rf"{B0}(?:bidder|offeror|supplier|vendor){B1}.{{0,50}}{B0}(?:expects?|requests?|proposes?|states?|says?|no longer applies){B1}",
    rf"{B0}(?:if|unless|when|once|provided(?: that)?|assuming|pending|contingent|conditional(?:ly)?\s+on|conditioned\s+on|on\s+condition\s+that|subject(?: only)?\s+to|only\s+(?:if|after)|in\s+the\s+event){B1}",
    rf"{B0}(?:following|after|on|upon|effective\s+(?:after|on|upon)){B1}.{{0,60}}{B0}(?:approval|approved|authorization|authorized|acceptance|accepted|funding|exercise|execution|option){B1}",
    rf"{B0}(?:for discussion|discussion only|for reference|for illustration|under review|under consideration){B1}",
]
PROPOSED = rf"{B0}(?:propos(?:e|ed|ing)|recommend(?:ed|ing)?|consider(?:ed|ing)?|plan(?:ned|ning)?|intend(?:ed|ing)?){B1}.{{0,50}}{B0}(?:to\s+be\s+)?(?:{DONE}){B1}"
KEPT = rf"{B0}(?:remain(?:s|ed)?\s+(?:unchanged|the same|in force)|stay(?:s|ed)?\s+(?:unchanged|the same)|(?:is|are|was|were)\s+(?:unchanged|the same)|unchanged|continu(?:e|es|ed)\s+in force|still applies?|no changes?|without changes?){B1}"
NEGATED = [
    rf"{B0}(?:not|never|cannot|no longer|by no means){B1}.{{0,60}}{B0}(?:{DONE}){B1}",
    rf"{B0}(?:do|does|did|will|would|shall|should|can|could|is|are|was|were)\s+not\s+(?:apply|take effect|become effective|control){B1}",
    rf"{B0}(?:is|are|was|were)\s+(?:excluded|void|withdrawn|rejected|declined){B1}",
]
SPECULATIVE = [
    rf"{B0}(?:may|might|can|could|would|should)\s+(?:be\s+)?(?:{DONE}){B1}",
    rf"{B0}(?:proposal|request|option|draft|recommendation)\s+to\s+(?:{TO_DO}){B1}",
    rf"{B0}(?:if|unless|provided that|subject to|pending){B1}.{{0,80}}{B0}(?:approval|approved|acceptance|accepted|authorize|authorized){B1}",
    rf"{B0}(?:{DONE}){B1}.{{0,80}}{B0}(?:proposal|request|draft|rejected|declined|pending approval|subject to approval){B1}",
]
AUTHORITY = r"(?:amendment|addendum|canada|buyer|contracting authority|department|agency)\s+(?:hereby\s+)?"
BEEN = r"(?:is|are|was|were|has been|have been|will be|shall be|must be)\s+(?:hereby\s+)?"
AFFIRMED = {
    "replace": [
        rf"{B0}{BEEN}(?:amended|changed|replaced|substituted|revised|extended|updated|superseded|increased|decreased|raised|reduced){B1}",
        rf"{B0}{AUTHORITY}(?:amends|changes|replaces|substitutes|revises|extends|updates|supersedes|increases|decreases|raises|reduces){B1}",
        rf"{B0}(?:amended|revised|updated|replacement)\s+(?:(?:technical|financial|price|evaluation|scoring|combined)\s+)?(?:ratio|weight|threshold|score|selection method|award basis|closing date|closing time|submission deadline|contract end date|projection horizon|basis of payment)\s+(?:is|are|equals?){B1}",
        rf"{B0}(?:amend|change|replace|substitute|revise|extend|update)\s*:",
        rf"^(?:amend|change|replace|substitute|revise|extend|update){B1}",
        rf"{B0}(?:is|are)\s+deleted{B1}.{{0,120}}{B0}and\s+replaced{B1}",
        rf"{B0}delete\s*:?.{{0,120}}{B0}replace\s+with\s*:",
    ],
    "delete": [
        rf"{B0}{BEEN}(?:deleted|removed|stricken|cancelled|canceled){B1}",
        rf"{B0}{AUTHORITY}(?:deletes|removes|strikes|cancels){B1}",
        rf"{B0}(?:delete|remove|strike|cancel)\s*:",
        rf"^(?:delete|remove|strike|cancel){B1}",
        rf"^(?:the\s+)?(?:insurance|commercial general liability|professional liability|basis of payment|appendix|criterion|contract|projection|forecast|solicitation|closing|submission|questions?|requirement){B1}.{{0,100}}{B0}no longer applies{B1}",
    ],
}
SCOPE_CUT = rf"{B0}(?:while|whereas|but){B1}|,\s*(?=in its entirety{B1})"
INSURANCE_CUT = rf"{SCOPE_CUT}|,\s*(?=(?:insurance\s+)?(?:coverage\s+)?(?:{OBJECTS}){B1})|\s+and\s+(?=(?:insurance\s+)?(?:coverage\s+)?(?:{OBJECTS}){B1})"
MOVED_FROM = rf"{B0}(?:extend(?:ed|s)?|chang(?:e|ed|es)|revis(?:e|ed|es)|updat(?:e|ed|es))\s+from{B1}.*{B0}(?:to|until|through){B1}"
CONDITION_FIRST = rf"^(?:if|unless|provided that|subject to|pending){B1}"


def _any(col: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, each tried in turn."""
    test = F.lit(False)
    for p in patterns:
        test |= col.rlike(p)
    return test


def affirms(scope: Column, effect: Column) -> Column:
    """Whether a scope in polarity form states the change as made; questions state none."""
    stated = F.when(effect == "delete", _any(scope, AFFIRMED["delete"])).otherwise(_any(scope, AFFIRMED["replace"]))
    return stated & ~F.contains(scope, F.lit("?")) & ~_any(scope, [*UNSETTLED, PROPOSED])


def clause_scopes(clause: Column) -> Column:
    """A clause in polarity form in scopes, each about one object; what is said of insurance is cut at its objects, too."""
    insured = clause.rlike(f"{B0}insurance{B1}")
    parts = F.transform(F.when(insured, F.split(clause, INSURANCE_CUT)).otherwise(F.split(clause, SCOPE_CUT)), lambda p: F.trim(p))
    named = F.transform(parts, lambda p: F.when(insured & ~p.rlike(f"{B0}insurance{B1}") & p.rlike(OBJECT_FIRST), F.concat(F.lit("insurance "), p)).otherwise(p))
    return F.filter(named, lambda p: p != "")


def _linked(scopes: Column, effect: Column) -> Column:
    """Scopes with the one before them where the two make one statement: a condition, or a deletion in its entirety with what replaces it."""

    def link(scope: Column, at: Column) -> Column:
        before = F.get(scopes, at - 1)
        whole = (effect == "replace") & before.rlike(f"{B0}(?:{DELETES}){B1}") & scope.rlike(f"{B0}in its entirety{B1}") & scope.rlike(f"{B0}(?:{REPLACES}){B1}")
        return F.when(whole, F.concat(before, F.lit(" "), scope)).when(before.rlike(CONDITION_FIRST), F.concat(before, F.lit(", "), scope)).otherwise(scope)

    return F.transform(scopes, link)


def action_scopes(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, effect, value, scope): the scopes of verified evidence that affirm the fact's change.

    Evidence that takes a change back anywhere has none. Values and scopes are in the form of evidence.
    """
    changes = facts.filter(F.col("effect").isin("replace", "delete")).select(*FACT, "effect", "value", F.lower("document_sha256").alias("_own"))
    joined = changes.join(citations.select(*FACT, "citation", "verified", "page", F.lower("document_sha256").alias("_cited"), "evidence_quote"), FACT)
    forms = stage(joined.select("*", normalised(F.col("value"), compose).alias("_value"), polarity_text(F.col("evidence_quote"), compose).alias("_spoken")), "changes")
    sound = forms.groupBy(*FACT).agg(F.bool_and(F.coalesce(F.col("verified") & F.col("page").isNotNull() & (F.col("_cited") == F.col("_own")), F.lit(False))).alias("_sound"), F.bool_or(F.col("_spoken").rlike(RESCINDED)).alias("_rescinded"))
    kept = forms.join(sound.filter("_sound AND NOT _rescinded").select(*FACT), FACT)
    clauses = kept.select(*FACT, "effect", F.col("_value").alias("value"), F.explode(F.split(F.col("_spoken"), SENTENCE_END)).alias("_clause"))
    verb = lambda c: F.when(F.col("effect") == "delete", c.rlike(f"{B0}(?:{DELETES}){B1}")).otherwise(c.rlike(f"{B0}(?:{REPLACES}){B1}"))
    open_ = clauses.withColumn("_clause", F.trim("_clause")).filter(verb(F.col("_clause")) & ~_any(F.col("_clause"), UNSETTLED))
    scopes = open_.select(*FACT, "effect", "value", F.explode(_linked(clause_scopes(F.col("_clause")), F.col("effect"))).alias("scope"))
    scope = F.col("scope")
    return scopes.filter(verb(scope) & ~_any(scope, [KEPT, *NEGATED, *SPECULATIVE]) & affirms(scope, F.col("effect"))).distinct()


def target_supports(target: Column, value: Column, there: Column, asserted: Column, date_only: Column) -> Column:
    """Whether what a change goes to, in polarity form, has the value, in the form of evidence; both with their tokens.

    A target with several tokens of one kind has to be asserted with all of them, so that no amount is paired with another's unit.
    """
    of = lambda tokens, kind: F.array_sort(F.filter(tokens, lambda t: t.startswith(kind)))
    whole = F.lit(True)
    for kind in TUPLES:
        whole &= (F.size(of(there, kind)) <= 1) | (of(there, kind) == of(asserted, kind))
    dates = of(asserted, "date:")
    dated = date_only & (F.size(dates) > 0) & (F.size(F.array_except(dates, there)) == 0)
    return F.when(F.size(asserted) > 0, whole & ((F.size(F.array_except(asserted, there)) == 0) | dated)).otherwise(supports_value(target, value))


def terminal_targets(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, terminal): what the last change that the evidence names goes to, by page, citation and sentence; partly aggregated before the shuffle."""
    spoken = citations.join(facts.filter("effect = 'replace'").select(*FACT), FACT).select(*FACT, "page", "citation", polarity_text(F.col("evidence_quote"), compose).alias("_spoken"))
    spoken = stage(spoken, "spoken") if compose else spoken
    each = spoken.select(*FACT, "page", "citation", F.posexplode(F.split("_spoken", SENTENCE_END)).alias("_at", "_scope"))
    named = each.withColumn("_target", mutation_target(F.trim("_scope"))).filter("_target IS NOT NULL")
    place = F.struct(F.col("page").isNull(), F.coalesce("page", F.lit(0)), "citation", "_at")
    return named.groupBy(*FACT).agg(F.max_by("_target", place).alias("terminal"))


def _evidence_rights(changes: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, _right): whether the evidence of changes binds their key and ends with their value."""
    deadline = F.col("fact_key").startswith("deadline:")
    scopes = action_scopes(changes, citations, compose).join(changes.select(*FACT, "fact_key"), FACT)
    # Written with their tokens, so that these are made once and not in each test below.
    tokens = lambda c: assertion_tokens(F.col(c), False)
    aimed = stage(scopes.withColumn("_target", mutation_target(F.col("scope"))), "aimed")
    scopes = stage(aimed.withColumns({"_asserted": tokens("value"), "_there": tokens("_target"), "_said": tokens("scope")}), "scopes")
    scope, value = F.col("scope"), F.col("value")
    goes = (F.col("effect") == "delete") | F.coalesce(target_supports(F.col("_target"), value, F.col("_there"), F.col("_asserted"), F.coalesce(deadline, F.lit(False))), F.lit(False))
    own = F.when(supports_value(scope, value), segment_key(scope, value))
    dates = lambda c: F.filter(F.col(c), lambda t: t.startswith("date:"))
    moved = scope.rlike(MOVED_FROM) & (F.size(dates("_said")) > 1) & F.arrays_overlap(dates("_said"), dates("_asserted"))
    names = F.when(deadline, (deadline_scope(scope) == F.col("fact_key")) | moved).otherwise((own == F.col("fact_key")) | F.col("fact_key").startswith(F.concat(own, F.lit(":"))))
    binding = scopes.groupBy(*FACT).agg(F.bool_or(goes & F.coalesce(names, F.lit(False))).alias("_binds"))
    last = terminal_targets(changes, citations, compose)
    plain = stage(changes.join(last, FACT, "left").join(binding, FACT, "left").withColumn("_plain", normalised(F.col("value"), compose)), "rights")
    plain = stage(plain.withColumns({"_asserted": F.when(F.col("terminal").isNotNull(), tokens("_plain")), "_there": tokens("terminal")}), "rights")
    ends = (F.col("effect") == "delete") | target_supports(F.col("terminal"), F.col("_plain"), F.col("_there"), F.col("_asserted"), F.coalesce(deadline, F.lit(False)))
    return stage(plain.select(*FACT, F.coalesce(F.col("_binds") & ends, F.lit(False)).alias("_right")), "rights")


def mutation_rights(facts: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """The facts with ``authorised``: true for additions, else whether the evidence has the right to the change.

    Facts come with their closed key (fact_keys.closed_keys), the role of their document and its stage, a number that grows
    with each amendment. A change without a key has no right. Changes with the same texts are judged as one case.
    """
    changes = facts.filter(F.col("effect").isin("replace", "delete")).select(*FACT, "effect", "value", "fact_key", F.lower("document_sha256").alias("_own"))
    sound = F.coalesce(F.col("verified") & F.col("page").isNotNull() & (F.lower("_cited") == F.col("_own")), F.lit(False))
    cited = citations.select(*FACT, "citation", "verified", "page", F.col("document_sha256").alias("_cited"), "evidence_quote")
    proof = cited.join(changes.select(*FACT, "_own"), FACT).select(*FACT, "page", "citation", sound.alias("verified"), "evidence_quote")
    place = F.struct(F.col("page").isNull(), F.coalesce("page", F.lit(0)), "citation")
    members, each, shown = cases(changes, FACT, ["effect", "value", "fact_key"], proof, ["verified", "evidence_quote"], place)
    one = {"document_sha256": F.lit("")}
    judged = _evidence_rights(each.withColumns(one), shown.withColumns(one | {"page": F.lit(1)}), compose)
    rights = members.join(judged.select(F.col("id").alias("_case"), "_right"), "_case").filter("_right").select(*FACT, "_right")
    first = facts.filter("fact_key IS NOT NULL").groupBy("package_id", "fact_key").agg(F.min("stage").alias("_first"))
    joined = facts.join(first, ["package_id", "fact_key"], "left").join(rights, FACT, "left")
    right = (F.col("role") == "amendment") & F.col("_right") & (F.col("fact_key").startswith("deadline:") | (F.col("_first") < F.col("stage")))
    return joined.withColumn("authorised", (F.col("effect") == "add") | F.coalesce(right, F.lit(False))).select(*facts.columns, "authorised")
