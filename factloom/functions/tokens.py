"""Scalar tokens: dates, times, offsets, amounts and bounds that can be compared without interpretation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B0, B1, nfkc

# Names of months, time zones with their offsets, currencies and magnitudes.
MONTHS = (("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"))
ZONES = {
    "utc": ("coordinated universal time|universal time coordinated", "+00:00"),
    "gmt": ("greenwich mean time", "+00:00"),
    "mst": ("mountain standard time", "-07:00"),
    "mdt": ("mountain daylight time", "-06:00"),
    "cst": ("central standard time", "-06:00"),
    "cdt": ("central daylight time", "-05:00"),
    "est": ("eastern standard time", "-05:00"),
    "edt": ("eastern daylight time", "-04:00"),
    "pst": ("pacific standard time", "-08:00"),
    "pdt": ("pacific daylight time", "-07:00"),
    "ast": ("atlantic standard time", "-04:00"),
    "adt": ("atlantic daylight time", "-03:00"),
    "nst": ("newfoundland standard time", "-03:30"),
    "ndt": ("newfoundland daylight time", "-02:30"),
}
CURRENCIES = "cad|usd|gbp|eur|aud|nzd|jpy|chf"
MAGNITUDES = "thousand|million|billion|trillion"
BOUNDS = {"minimum": r"at least|minimum(?: of)?|no less than", "maximum": r"at most|maximum(?: of)?|up to|no more than|not exceed(?:ing)?", "exact": r"exactly|equal to"}

_MONTH = "|".join(name for names in MONTHS for name in names)
_MONTH_NUMBER = {name: f"{i:02d}" for i, names in enumerate(MONTHS, 1) for name in names}
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_ORDINAL = r"(?:st|nd|rd|th)?"
#: Each form of a date with the groups of year, month and day; only valid months and days match.
_DATES = (
    (rf"(?<!\d)(\d{{4}})[-/.](0?[1-9]|1[0-2])[-/.]{_DAY}(?!\d)", (1, 2, 3)),
    (rf"{B0}({_MONTH})\.?\s+{_DAY}{_ORDINAL}[,]?\s+(\d{{4}}){B1}", (3, 1, 2)),
    (rf"{B0}{_DAY}{_ORDINAL}\s+({_MONTH})\.?[,]?\s+(\d{{4}}){B1}", (3, 2, 1)),
)
_TIME = r"(?<![+\-\d:])([01]?\d|2[0-3]):([0-5]\d)(?::\d{2})?\s*(a\.?m\.?|p\.?m\.?)?(?![\d:])"
_OFFSET = r"[+\-](?:0\d|1[0-4]):[0-5]\d"
_NUMBER = r"(?<![\p{L}\p{N}])(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.\d+)?(?![\p{L}\p{N}])"
#: Wide enough that numbers on either side of it are not read as one.
_BLANK = " " * 8


def _all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def canonical_number(col: Column) -> Column:
    """Digits without grouping, leading zeros and trailing fraction zeros."""
    bare = F.regexp_replace(F.regexp_replace(col, r"[\s,]", ""), r"^0+(?=\d)", "")
    return F.when(bare.contains("."), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")).otherwise(bare)


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix + ":"), v))


def _date_token(pattern: str, months: Column, year: int, month: int, day: int):
    def token(match: Column) -> Column:
        part = lambda n: F.regexp_extract(match, pattern, n)
        number = F.coalesce(months[part(month)], F.lpad(part(month), 2, "0"))
        return F.concat(F.lit("date:"), part(year), F.lit("-"), number, F.lit("-"), F.lpad(part(day), 2, "0"))

    return token


def assertion_tokens(col: Column, compose: bool = True) -> Column:
    """The sorted distinct tokens of a statement."""
    text = F.lower(nfkc(col) if compose else col)
    none = F.array().cast("array<string>")
    some = lambda test, *tokens: F.when(test, F.array(*map(F.lit, tokens))).otherwise(none)
    months = F.create_map(*[F.lit(x) for pair in _MONTH_NUMBER.items() for x in pair])
    found = [some(text.rlike(f"{B0}(?:{names}|{zone}){B1}"), f"timezone:{zone}", f"utc-offset:{offset}") for zone, (names, offset) in ZONES.items()]
    found += [some(text.rlike(f"{B0}(?:{words}){B1}"), f"bound:{kind}") for kind, words in BOUNDS.items()]
    found.append(_prefixed("utc-offset", _all(text, rf"(?<![\p{{L}}\p{{N}}]){_OFFSET}{B1}")))
    found.append(_prefixed("utc-offset", _all(text, rf"[t ]\d{{2}}:\d{{2}}(?::\d{{2}})?({_OFFSET}){B1}", 1)))
    percent = _all(text, r"(?<![\p{L}\p{N}])(\d+(?:\.\d+)?)\s*(?:%|per\s*cent|percent(?:age)?)(?!\p{L})", 1)
    found.append(_prefixed("percent", F.transform(percent, canonical_number)))
    found.append(_prefixed("currency", _all(text, f"{B0}(?:{CURRENCIES}){B1}")))
    found.append(_prefixed("magnitude", _all(text, f"{B0}(?:{MAGNITUDES}){B1}")))
    rest = text
    for pattern, (year, month, day) in _DATES:
        found.append(F.transform(_all(text, pattern), _date_token(pattern, months, year, month, day)))
        rest = F.regexp_replace(rest, pattern, _BLANK)

    def clock(m: Column) -> Column:
        hour = F.regexp_extract(m, _TIME, 1).cast("int")
        half = F.regexp_replace(F.regexp_extract(m, _TIME, 3), r"\.", "")
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        return F.concat(F.lit("time:"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(m, _TIME, 2))

    found.append(F.transform(_all(rest, _TIME), clock))
    rest = F.regexp_replace(F.regexp_replace(rest, _TIME, _BLANK), rf"[+\-]\d{{2}}:\d{{2}}{B1}", _BLANK)
    found.append(_prefixed("number", F.transform(_all(rest, _NUMBER), canonical_number)))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def tokens_supported(asserted: Column, evidence: Column) -> Column:
    """Whether all asserted tokens are among the evidence's; a statement without tokens is supported."""
    return F.size(F.array_except(asserted, evidence)) == 0
