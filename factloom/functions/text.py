"""Text functions as column expressions; only Unicode normalisation needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of the source language, and what evidence normalisation folds.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
INVISIBLE = r"[\u00ad\u200b-\u200d\ufeff]"
DASHES = "‐‑‒–—―"
QUOTES = "“”‘’"
PLAIN_QUOTES = "\"\"''"

#: Word limits that hold for ASCII letters, digits and underscores only, whatever the regex engine's own rule is.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EDGE = rf"(?:{B0}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){B1})"


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@cache
def _nfkc_udf():
    """Made once, so that Spark sees equal calls as equal and evaluates them once."""
    return F.pandas_udf(_nfkc, StringType(), F.PandasUDFType.SCALAR)


def nfkc(col: Column) -> Column:
    return _nfkc_udf()(col)


#: The same characters as in SPACE, one by one.
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def display_text(col: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def normalised(col: Column, compose: bool = True) -> Column:
    """The form in which evidence is compared. ``compose=False`` leaves out NFKC, for text known to be in that form."""
    col = nfkc(col) if compose else col
    plain = F.translate(F.regexp_replace(col, INVISIBLE, ""), DASHES + QUOTES, "-" * len(DASHES) + PLAIN_QUOTES)
    return F.lower(display_text(F.when(F.length(col) == F.octet_length(col), col).otherwise(plain)))


def polarity_text(col: Column, compose: bool = True) -> Column:
    """Normalised, with contracted negations written out."""
    col = normalised(col, compose)
    for short, long in (("can't", "cannot"), ("won't", "will not"), ("ain't", "is not")):
        col = F.regexp_replace(col, rf"{B0}{short}{B1}", long)
    return F.regexp_replace(col, rf"{B0}(is|are|was|were|has|have|had|does|do|did|would|should|could|must|may|might)n't{B1}", "$1 not")


def without_controls(col: Column, most: int = 500_000) -> Column:
    return F.substring(F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), 1, most)


# Words that do not tell one statement from another.
STOP_WORDS = "a an and are as at be been by for from has have in is it of on or that the this to was were will with".split()
TOPIC_STOP_WORDS = "a an and as at by clause controlling current for from in of original required requirement rule the to value".split()
TOPIC_SYNONYMS = {"deadline": "closing", "timestamp": "date", "due": "closing", "initial": "first", "term": "period", "ending": "end", "ends": "end"}


def significant_words(col: Column) -> Column:
    """The distinct words of three or more ASCII letters that are not stop words."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def topic_tokens(col: Column, compose: bool = True) -> Column:
    """The distinct words of a topic, with phrases and synonyms made one."""
    col = F.regexp_replace(normalised(col, compose), rf"{B0}closing\s+(?:date|timestamp|deadline){B1}", "closing")
    col = F.regexp_replace(F.regexp_replace(col, rf"{B0}end\s+year{B1}", "horizon"), rf"{B0}projection[- ]horizon{B1}", "projection horizon")
    same = F.create_map(*[F.lit(x) for pair in TOPIC_SYNONYMS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.coalesce(same[w], w))
    return F.array_except(words, F.array(*map(F.lit, TOPIC_STOP_WORDS)))


def question_tokens(col: Column, compose: bool = True) -> Column:
    """The distinct runs of three or more ASCII letters and digits, in normalised form; what that does to spaces, dashes and quotes changes no run."""
    col = nfkc(col) if compose else col
    plain = F.lower(F.when(F.length(col) == F.octet_length(col), col).otherwise(F.regexp_replace(col, INVISIBLE, "")))
    return F.array_distinct(F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def sentences(col: Column, least: int = 20, most: int = 450) -> Column:
    """Sentences by their end mark, of a length between the bounds."""
    parts = F.transform(F.split(F.regexp_replace(col, rf"{SPACE}+", " "), r"(?<=[.!?;:])\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda s: F.length(s).between(least, most))


# Requests that leave the documents, and attempts to change the instructions.
EXTERNAL_REQUEST = rf"(?i){B0}(?:browse|internet|web search|google|follow (?:the )?link|open (?:the )?url|latest news|outside (?:the )?documents?){B1}"
PROMPT_OVERRIDE = rf"(?i){B0}(?:ignore (?:all |the )?(?:previous|system)|system prompt|developer message|call (?:a )?tool|execute (?:this )?code){B1}"


def leaves_closed_world(col: Column) -> Column:
    return col.rlike(EXTERNAL_REQUEST) | col.rlike(PROMPT_OVERRIDE)


def canonical_json_digest(*cols: str) -> Column:
    """SHA-256 of a struct written as JSON with its keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
