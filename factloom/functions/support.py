"""Whether evidence supports a statement: polarity, definiteness, scalar tokens and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B0, B1, normalised, polarity_text, significant_words
from .tokens import assertion_tokens

# Words that make a statement conditional, tentative or negative, and where one span of evidence ends.
CONDITIONAL = rf"{B0}(?:if|unless|when|once|provided(?: that)?|assuming|pending|contingent|conditional(?:ly)?\s+on|conditioned\s+on|on\s+condition\s+that|subject(?: only)?\s+to|only\s+(?:if|after)|in\s+the\s+event){B1}|{B0}(?:following|after|on|upon|effective\s+(?:after|on|upon)){B1}.{{0,60}}{B0}(?:approval|approved|authorization|authorized|acceptance|accepted|funding|exercise|execution|option){B1}"
TENTATIVE = rf"{B0}(?:may|might|can|could|would|should|proposed|proposal|draft|expected|anticipated|possible|potential|option|alternative){B1}"
NEGATIVE = rf"{B0}not{B1}(?!\s+(?:less|more)\s+than{B1}|\s+exceed(?:ing)?{B1})|{B0}(?:never|neither|nor|no longer|cannot|under no circumstances|anything but|everything but|other than|different from|unrelated to|without(?:\s+the\s+(?:use|application)\s+of)?|excluded?|optional){B1}|{B0}no\s+(?!later\s+than{B1}|less\s+than{B1}|more\s+than{B1})"
COMPARED = rf"{B0}(?:exceeds?|above|below|before|after|precedes?|follows?|greater than|less than|replaces?|supersedes?){B1}"
PARTIES = "the|a|an|this|that|these|those|bidder|offeror|proponent|tenderer|contractor|supplier|vendor"
SPAN_END = rf"(?i)(?<!a\.m)(?<!p\.m)\.\s+|[;\n]+|{B0}(?:while|whereas|but|although|yet){B1}|\s+and\s+(?=(?:{PARTIES})\s+)"
MANDATORY = rf"{B0}mandatory{B1}|{B0}condition(?:s)? of (?:bid|tender){B1}|{B0}non-compliant{B1}|{B0}noncompliant{B1}|{B0}(?:bidder|offeror|proponent|tenderer){B1}.{{0,100}}{B0}(?:must|shall|required to){B1}.{{0,100}}{B0}(?:submit|provide|demonstrate|propose|include|complete|sign|obtain){B1}"
LOCATED = rf"{B0}mandatory{B1}.{{0,80}}{B0}(?:criteria|requirements?){B1}.{{0,80}}{B0}(?:included|contained|located|set out|found|provided|listed|described){B1}.{{0,50}}{B0}(?:annex|appendix|attachment|section){B1}"
OBLIGED = rf"{B0}(?:bidder|offeror|proponent|tenderer){B1}.{{0,120}}{B0}(?:must|shall|required to){B1}"
#: Kinds of tokens of which a span may have none that the statement leaves out.
COMPLETE = ("bound:", "currency:", "magnitude:", "percent:", "date:", "time:", "utc-offset:")
METHODS = {"highest_combined_rating": r"highest\s+combined\s+rating", "lowest_evaluated_price": r"lowest\s+evaluated\s+(?:total\s+)?price", "lowest_price": r"lowest\s+(?:total\s+)?price", "best_value": r"best\s+value", "highest_score": r"highest\s+(?:technical\s+)?score"}
RELEVANT = {
    "mandatory_gate": rf"(?=.*{B0}mandatory{B1})(?=.*(?:{B0}(?:fail|failed|fails|non-compliant|noncompliant|must|required|responsive){B1}|{B0}(?:meet|meets|satisfy|satisfies)\s+all\s+mandatory{B1}))",
    "rated_threshold": rf"{B0}(?:minimum|threshold|points?|rating|score|rated){B1}",
    "technical_weight": rf"(?=.*{B0}technical{B1})(?=.*(?:%|percent|ratio|weight))",
    "financial_weight": rf"(?=.*{B0}(?:financial|price){B1})(?=.*(?:%|percent|ratio|weight))",
    "selection_method": rf"{B0}(?:award|selection|select|selected|rating|lowest|highest){B1}",
}


def is_definitive(plain: Column) -> Column:
    """Of a text in polarity form: neither tentative, conditional nor negative."""
    return ~plain.rlike(TENTATIVE) & ~plain.rlike(CONDITIONAL) & ~plain.rlike(NEGATIVE)


def evidence_spans(quote: Column, compose: bool = True) -> Column:
    """A quote in polarity form, in spans that each say one thing."""
    return F.filter(F.transform(F.split(polarity_text(quote, compose), SPAN_END), lambda p: F.trim(p)), lambda s: s != "")


def span_supports(assertion: Column, span: Column, compose: bool = True) -> Column:
    """Whether one span of evidence, in polarity form, says what the assertion says.

    Both have the same polarity; a definitive statement needs a definitive span; the span has no amount, date or
    bound that the statement leaves out. Then the statement stands in the span, or else all its words do, unless
    it compares things or has two values of one kind.
    """
    plain, spoken = normalised(assertion, compose), polarity_text(assertion, compose)
    asserted, shown = assertion_tokens(assertion, compose), assertion_tokens(span, False)
    left_out = F.exists(F.array_except(shown, asserted), lambda t: t.rlike("^(?:" + "|".join(COMPLETE) + ")"))
    kinds = F.transform(asserted, lambda t: F.split_part(t, F.lit(":"), F.lit(1)))
    one_of_each = F.size(kinds) == F.size(F.array_distinct(kinds))
    words = F.size(F.array_except(significant_words(plain), significant_words(span))) == 0
    said = ((F.length(plain) >= 3) & F.contains(span, plain)) | (one_of_each & ~plain.rlike(COMPARED) & words)
    return (spoken.rlike(NEGATIVE) == span.rlike(NEGATIVE)) & (~is_definitive(spoken) | is_definitive(span)) & ~left_out & said


def mandatory_span(span: Column) -> Column:
    """Whether a span in polarity form lays down something mandatory."""
    return is_definitive(span) & span.rlike(MANDATORY)


def only_points_elsewhere(text: Column, compose: bool = True) -> Column:
    """Whether a text says where mandatory criteria are, without laying any down."""
    plain = polarity_text(text, compose)
    return plain.rlike(LOCATED) & ~plain.rlike(OBLIGED)


def methods_in(plain: Column) -> Column:
    """All selection methods that a text in lower case names."""
    return F.array_compact(F.array(*[F.when(plain.rlike(B0 + pattern + B1), F.lit(name)) for name, pattern in METHODS.items()]))


def selection_method(text: Column, compose: bool = True) -> Column:
    """The one selection method that a text names; null if it names none or several. The lowest evaluated price is not also the lowest price."""
    named = methods_in(normalised(text, compose))
    found = F.when(F.array_contains(named, "lowest_evaluated_price"), F.array_remove(named, "lowest_price")).otherwise(named)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def relevant_to(field: Column, quote: Column, compose: bool = True) -> Column:
    """Whether a quote can be evidence for an evaluation field."""
    plain, case = normalised(quote, compose), None
    for name, pattern in RELEVANT.items():
        case = (F if case is None else case).when(field == name, plain.rlike(pattern))
    return case.otherwise(F.lit(False))
