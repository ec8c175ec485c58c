"""Evaluation rules: what their citations bind a field to, which rules stand, and a package's fields.

Rules have package_id, rule_id, field and value; citations have these two ids, evidence_quote and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.support import METHODS, evidence_spans, is_definitive, relevant_to, selection_method
from factloom.functions.text import B0, B1, normalised, polarity_text, significant_words
from factloom.functions.tokens import assertion_tokens, tokens_supported
from factloom.sources.staging import stage

from .cases import cases

RULE = ["package_id", "rule_id"]
WEIGHTS = {"technical_weight": "technical", "financial_weight": "financial|price"}
# How percentages, least scores and scales are worded, what ends a clause, and how an award names its method.
NUMBER = r"(\d+(?:\.\d+)?)"
PERCENT = NUMBER + r"\s*(?:%|per\s*cent|percent(?:age)?)"
CLAUSE_END = rf"[,;+]|{B0}(?:and|while|whereas|versus|vs\.?){B1}"
SCORE_SPAN_END = r"(?<!a\.m)(?<!p\.m)\.\s+|[;,\n]+"
LEAST = (
    rf"{B0}(?:minimum(?: score)?(?: of)?|threshold(?: of)?|at least|no less than){B1}[^\d]{{0,60}}{NUMBER}",
    rf"{NUMBER}\s*(?:points?)?[^\d]{{0,30}}{B0}(?:is|as)?\s*(?:the\s+)?(?:minimum|threshold){B1}",
    rf"{B0}(?:must|required to)\s+(?:obtain|achieve|score|receive|attain){B1}[^\d]{{0,60}}{NUMBER}",
)
OF_SCALE = (rf"(?<![\d.]){NUMBER}\s*/\s*{NUMBER}(?![\d.])", rf"(?<![\d.]){NUMBER}\s*(?:points?)?\s*(?:out of|on (?:a )?scale of)\s*(?:a\s+possible\s+)?{NUMBER}(?![\d.])")
SCALE = rf"{B0}(?:out of|scale of|possible(?: score)?(?: of)?|maximum(?: score)?(?: of)?){B1}[^\d]{{0,30}}{NUMBER}"
METHOD = "(?:" + "|".join(METHODS.values()) + ")"
AWARDS = (
    rf"{B0}(?:award|selection){B1}.{{0,80}}?{B0}(?:uses?|based\s+on|determined\s+by|will\s+be\s+made\s+to|shall\s+be\s+made\s+to){B1}.{{0,140}}?{B0}({METHOD}){B1}",
    rf"{B0}(?:selects?|recommends?|awards?){B1}.{{0,140}}?{B0}({METHOD}){B1}",
    rf"{B0}({METHOD}){B1}.{{0,140}}?{B0}(?:will|shall)\s+be\s+(?:selected|recommended|awarded){B1}",
    rf"{B0}(?:bids?|offers?|proposals?|tenders?){B1}.{{0,100}}?{B0}with{B1}.{{0,100}}?{B0}({METHOD}){B1}.{{0,100}}?{B0}for\s+award{B1}",
)
NOT_AWARDED = rf"{B0}(?:not|never|no longer|cannot|excluded?|excluding|except(?:ed|ing)?|prohibited|other[ -]than|anything[ -]but|everything[ -]but|rather[ -]than|instead[ -]of|as[ -]opposed[ -]to|apart[ -]from|save(?: for)?|in[ -]lieu[ -]of|exclusive[ -]of|disregard(?:s|ed|ing)?|regardless[ -]of|by no means|without[ -]regard(?:[ -]to)?|irrespective(?:[ -]of)?){B1}"
SCORING = rf"{B0}(?:award|evaluation|scoring|rating|ranking|price|technical|financial)\s+points?{B1}|{B0}(?:ranking|proximity|difference|distance|variance)\s+(?:from|to){B1}"
NO_GATE = rf"{B0}(?:no|not|without){B1}.{{0,40}}{B0}mandatory{B1}"
#: The share of a free value's words that the evidence has to have.
SHARED_WORDS = 0.6


def _numbers(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x.cast("double"))


def _gathered(spans: Column, *patterns: tuple[str, int]) -> Column:
    """All distinct numbers that the patterns' groups find in an array of texts."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.concat(*[_numbers(s, p, g) for p, g in patterns]))))


def weight_values(plain: Column, label: str) -> Column:
    """The percentages that a quote, in lower case, gives the weight ``label``: alone in a clause, or next to the label with no other between."""
    mine, other = WEIGHTS[label], next(v for k, v in WEIGHTS.items() if k != label)
    clauses = F.filter(F.split(plain, CLAUSE_END), lambda c: is_definitive(c) & c.rlike(rf"{B0}(?:{mine}){B1}") & ~c.rlike(rf"{B0}(?:{other}){B1}"))
    of_clauses = F.flatten(F.filter(F.transform(clauses, lambda c: F.filter(_numbers(c, rf"(?<![\d.]){PERCENT}(?![a-z])"), lambda x: x <= 100)), lambda v: F.size(v) == 1))
    between = rf"(?:(?!{B0}(?:{other}){B1}|{CLAUSE_END}|\d).){{0,80}}?"
    beside = F.when(is_definitive(plain), F.concat(_numbers(plain, rf"{B0}(?:{mine}){B1}{between}{PERCENT}"), _numbers(plain, rf"{PERCENT}{between}{B0}(?:{mine}){B1}"))).otherwise(F.array().cast("array<double>"))
    return F.array_distinct(F.concat(of_clauses, beside))


def threshold_values(plain: Column) -> tuple[Column, Column]:
    """The least scores and the scales that a quote, in lower case, lays down."""
    spans = F.filter(F.transform(F.split(plain, SCORE_SPAN_END), lambda p: F.trim(p)), lambda s: (s != "") & is_definitive(s))
    return _gathered(spans, *[(p, 1) for p in (*LEAST, *OF_SCALE)]), _gathered(spans, (SCALE, 1), *[(p, 2) for p in OF_SCALE])


def stated_threshold(plain: Column) -> tuple[Column, Column]:
    """The least score and the scale of a value, in lower case; the scale is null for a single number, both for anything else."""
    pattern = rf"(?<![\d.]){NUMBER}\s*(?:/|out of)\s*{NUMBER}(?![\d.])"
    alone = _numbers(plain, rf"(?<![\d.]){NUMBER}(?![\d.])")
    least = F.coalesce(F.regexp_extract(plain, pattern, 1).try_cast("double"), F.when(F.size(alone) == 1, F.element_at(alone, 1)))
    return least, F.regexp_extract(plain, pattern, 2).try_cast("double")


def awarded_methods(quote: Column, compose: bool = True) -> Column:
    """The selection methods that a quote says the award is made by, in definite and unnegated spans that are not about points."""
    spans = F.filter(evidence_spans(quote, compose), lambda s: is_definitive(s) & ~s.rlike(NOT_AWARDED) & ~s.rlike(SCORING))
    named = F.flatten(F.transform(spans, lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in AWARDS])))
    return F.array_distinct(F.array_compact(F.transform(named, lambda n: selection_method(n, False))))


def parsed_value(field: Column, value: Column) -> Column:
    """A rule's value as its field has it: true or false, a number from 0 to 100, or the trimmed text; null if it is none of these."""
    plain = F.lower(F.trim(value))
    number = F.regexp_replace(plain, "%", "").try_cast("double")
    return F.when(field == "mandatory_gate", F.when(plain.isin("true", "false"), plain)).when(field.isin(*WEIGHTS), F.when(number.between(0, 100), number.cast("string"))).otherwise(F.nullif(F.trim(value), F.lit("")))


def validated_rules(rules: DataFrame, citations: DataFrame, compose: bool = True) -> DataFrame:
    """The rules with ``valid`` and n_bound, how many of their relevant citations bind the value.

    All relevant citations have to be verified, and there has to be one; their numbers have to agree on the value. Rules with
    the same texts are judged as one case.
    """
    members, each, shown = cases(rules, RULE, ["field", "value"], citations, ["verified", "evidence_quote"])
    judged = stage(_judged_rules(each.withColumnRenamed("id", "rule_id"), shown.withColumnRenamed("id", "rule_id"), compose), "judged")
    known = members.join(judged.select(F.col("rule_id").alias("_case"), "valid", "n_bound"), "_case").drop("_case")
    return rules.join(known, RULE, "left").withColumns({"valid": F.coalesce("valid", F.lit(False)), "n_bound": F.coalesce("n_bound", F.lit(0).cast("long"))})


def _judged_rules(rules: DataFrame, citations: DataFrame, compose: bool) -> DataFrame:
    field, quote = F.col("field"), F.col("evidence_quote")
    proof = citations.select(*RULE, "evidence_quote", "verified")
    near = rules.select(*RULE, "field", "value").join(proof, RULE).filter(relevant_to(field, quote, compose))
    plain = near.withColumns({"_quote": normalised(quote, compose), "_definite": is_definitive(polarity_text(quote, compose)), "_methods": F.when(field == "selection_method", awarded_methods(quote, compose)), "_tokens": assertion_tokens(quote, compose), "_plain": normalised(F.col("value"), compose)})
    none = F.array().cast("array<double>")
    weights = F.when(field == "technical_weight", weight_values(F.col("_quote"), "technical_weight")).when(field == "financial_weight", weight_values(F.col("_quote"), "financial_weight")).otherwise(none)
    least, scale = threshold_values(F.col("_quote"))
    score = field == "rated_threshold"
    told_least, told_scale = stated_threshold(F.col("_plain"))
    number = F.regexp_replace("_plain", "%", "").try_cast("double")
    bound = plain.withColumns({"_values": F.when(score, least).otherwise(weights), "_scales": F.when(score, scale).otherwise(none), "_told": F.when(score, told_least).otherwise(F.when(number.between(0, 100), number)), "_told_scale": F.when(score, told_scale), "_told_method": selection_method(F.col("value"), compose)})
    has = lambda values, told: F.coalesce(F.array_contains(values, F.col(told)), F.lit(False))
    binds = (
        F.when(field == "mandatory_gate", F.when(F.col("_plain") == "true", F.col("_definite")).otherwise(F.col("_plain") == "false"))
        .when(score, has("_values", "_told") & (F.col("_told_scale").isNull() | has("_scales", "_told_scale")))
        .when(field.isin(*WEIGHTS), has("_values", "_told"))
        .when(field == "selection_method", F.col("_methods") == F.array("_told_method"))
        .otherwise(True)
    )
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    sums = bound.groupBy(*RULE, "field", "value").agg(
        F.bool_and("verified").alias("_verified"), all_of("_tokens").alias("_shown"), all_of("_values").alias("_all"), all_of("_scales").alias("_all_scales"), F.count_if(binds).alias("n_bound"),
        F.max("_told").alias("_told"), F.max("_told_scale").alias("_told_scale"), F.max("_plain").alias("_plain"), F.bool_or(F.col("_quote").rlike(NO_GATE)).alias("_no_gate"), all_of(significant_words(F.col("_quote"))).alias("_words"),
    )
    only = (F.size("_all") == 1) & F.array_contains("_all", F.col("_told"))
    scale_agrees = F.col("_told_scale").isNull() | ((F.size("_all_scales") == 1) & F.array_contains("_all_scales", F.col("_told_scale")))
    words = significant_words(F.col("_plain"))
    stands = (
        F.when(field == "mandatory_gate", (F.col("_plain") == "true") | ((F.col("_plain") == "false") & F.col("_no_gate")))
        .when(score, only & scale_agrees)
        .when(field.isin(*WEIGHTS), only)
        .when(field == "selection_method", F.lit(True))
        .otherwise((F.size(words) > 0) & (F.size(F.array_intersect(words, "_words")) >= SHARED_WORDS * F.size(words)))
    )
    supported = tokens_supported(assertion_tokens(F.col("value"), compose), F.col("_shown"))
    valid = F.coalesce(F.col("_verified") & supported & stands & (F.col("n_bound") > 0), F.lit(False))
    judged = sums.select(*RULE, valid.alias("valid"), "n_bound")
    no = F.lit(0).cast("long")
    return rules.join(judged, RULE, "left").withColumns({"valid": F.coalesce("valid", F.lit(False)), "n_bound": F.when(F.coalesce("valid", F.lit(False)), F.col("n_bound")).otherwise(no)})
