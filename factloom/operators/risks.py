"""What the parts of a risk rest on: its finding, its impact and the action that it recommends.

Each part has a lineage of its own, and the parts' dependence on facts that no longer hold is merged: a risk is stale if
its finding is bound to such a fact's key and a part repeats a value of it; mixed if a part does so apart from the finding;
ambiguous if it may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.support import evidence_spans, span_supports
from factloom.functions.text import nfkc
from factloom.functions.tokens import assertion_tokens
from factloom.sources.staging import stage

from .cases import cases
from .fact_keys import FACT, judged_lineage, once

PARTS = ("finding", "impact", "action")
#: The states of a risk, each above those before it.
STATES = ("none", "ambiguous", "mixed", "stale")


def risk_parts(risks: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, part, value, lineage, keys) of risks (package_id, id, document_sha256 and the parts).

    Impact and action have a lineage only where a span of the evidence says what they say; one that has no bound lineage and no
    amounts or dates takes the finding's. Risks with the same texts are judged as one case.
    """
    cited = citations.filter("verified").select(*FACT, F.lower("document_sha256").alias("_cited"), "evidence_quote")
    own = F.coalesce(F.col("_cited") == F.lower("document_sha256"), F.lit(False))
    proof = cited.join(risks.select(*FACT, "document_sha256"), FACT).select(*FACT, own.alias("own"), "evidence_quote").distinct()
    members, each, shown = cases(risks, FACT, list(PARTS), proof, ["own", "evidence_quote"])
    shown = shown.select(*FACT, F.when(F.col("own"), "own").otherwise("other").alias("document_sha256"), F.lit(True).alias("verified"), "evidence_quote")
    judged = stage(_judged_parts(each.withColumn("document_sha256", F.lit("own")), shown, compose), "judged")
    return members.join(judged.drop("package_id").withColumnRenamed("id", "_case"), "_case").select(*FACT, "part", "value", "lineage", "keys")


def _judged_parts(risks: DataFrame, citations: DataFrame, compose: bool) -> DataFrame:
    text = lambda c: nfkc(F.col(c)) if compose else F.col(c)
    each = risks.select(*FACT, "document_sha256", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), text(p).alias("value")) for p in PARTS])).alias("p"))
    parts = stage(each.select("package_id", F.struct("id", "p.part").alias("id"), "p.value", "document_sha256"), "parts")
    proof = stage(citations.select(*FACT, "document_sha256", "verified", text("evidence_quote").alias("evidence_quote")), "proof")
    of_parts = parts.select("package_id", "id", F.col("id.id").alias("_id")).join(proof.withColumnRenamed("id", "_id"), ["package_id", "_id"]).drop("_id")
    known = judged_lineage(parts, of_parts, compose=False)
    spans = of_parts.filter("verified").select(*FACT, F.explode(evidence_spans(F.col("evidence_quote"), False)).alias("_span"))
    derived = parts.filter("id.part != 'finding'").select(*FACT, "value").join(spans, FACT)
    told = once(derived, ["value", "_span"], _says=span_supports(F.col("value"), F.col("_span"), False))
    said = told.groupBy(FACT).agg(F.bool_or("_says").alias("_said"))
    finding = known.filter("id.part = 'finding' AND lineage = 'bound'").select("package_id", F.col("id.id").alias("_of"), F.col("keys").alias("_inherited"))
    met = known.join(said, FACT, "left").withColumn("_of", F.col("id.id")).join(finding, ["package_id", "_of"], "left")
    own = (F.col("id.part") == "finding") | F.coalesce("_said", F.lit(False))
    met = once(met, ["value"], _tokens=assertion_tokens(F.col("value"), False))
    bare = F.coalesce(F.size("_tokens"), F.lit(0)) <= 0
    takes = (F.col("id.part") != "finding") & F.col("_inherited").isNotNull() & ~(own & (F.col("lineage") == "bound")) & bare
    none = F.array().cast("array<string>")
    return met.select(
        "package_id", F.col("_of").alias("id"), "id.part", "value",
        F.when(takes, "bound").when(own, F.col("lineage")).otherwise("unbound").alias("lineage"), F.when(takes, F.col("_inherited")).when(own, F.col("keys")).otherwise(none).alias("keys"),
    )


def gone_tokens(facts: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, fact_key, token): what superseded facts of a key say and no active one does; keys with a conflict have none."""
    told = once(facts.filter("fact_key IS NOT NULL"), ["value"], _tokens=assertion_tokens(F.col("value"), compose))
    each = told.select("package_id", "fact_key", "status", F.explode_outer("_tokens").alias("token"))
    is_ = lambda status: F.bool_or(F.col("status") == status)
    by_token = each.groupBy("package_id", "fact_key", "token").agg(is_("superseded").alias("_old"), is_("active").alias("_new"), is_("conflicted").alias("_disputed"))
    disputed = by_token.filter("_disputed").select("package_id", "fact_key").distinct()
    return by_token.filter("token IS NOT NULL AND _old AND NOT _new").join(disputed, ["package_id", "fact_key"], "left_anti").select("package_id", "fact_key", "token")


def risk_dependencies(parts: DataFrame, facts: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, id, dependency) of every risk: the greatest of its STATES over all keys of superseded facts."""
    gone = gone_tokens(facts, compose)
    parts = once(parts, ["value"], _tokens=assertion_tokens(F.col("value"), False))
    tokens = parts.select(*FACT, "part", "lineage", "keys", F.explode("_tokens").alias("token"))
    finding = parts.filter("part = 'finding'").select(*FACT, F.when(F.col("lineage") == "bound", F.element_at("keys", 1)).alias("_finding_key"))
    met = tokens.join(gone, ["package_id", "token"]).join(finding, FACT)
    of_key = F.array_contains("keys", F.col("fact_key"))
    matching = (F.col("lineage") == "bound") & of_key
    state = (
        F.when(matching & (F.col("_finding_key") == F.col("fact_key")), 3)
        .when(matching | ((F.col("part") != "finding") & (F.col("lineage") == "unbound")), 2)
        .when((F.col("lineage") == "ambiguous") & of_key, 1)
        .otherwise(0)
    )
    most = met.groupBy(FACT).agg(F.max(state).alias("_state"))
    names = F.array(*map(F.lit, STATES))
    return parts.select(*FACT).distinct().join(most, FACT, "left").select(*FACT, F.element_at(names, F.coalesce("_state", F.lit(0)) + 1).alias("dependency"))
