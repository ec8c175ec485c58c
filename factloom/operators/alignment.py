"""Where a quote stands in a source, exactly or but for the width of its white space, and sealed manifests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import json_bytes

#: The longest quote, and the most bytes of a sealed manifest.
LONGEST, MOST_BYTES = 500, 524_288


def _starts(text: str | None, needle: str | None) -> list[int]:
    found, at = [], text.find(needle) if text and needle else -1
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def _selectors(text: str | None, quote: str | None) -> list[tuple[int, int]] | None:
    if text is None or not quote or len(quote) > LONGEST or quote[0].isspace() or quote[-1].isspace():
        return None
    loose = r"\s+".join(re.escape(part) for part in quote.split())
    found = [(m.start(1), m.end(1)) for m in re.finditer(f"(?=({loose}))", text)]
    return None if any(end - start > LONGEST for start, end in found) else found


def occurrences(text: Column, needle: Column) -> Column:
    """All places at which the needle starts in the text, in code points from zero, overlaps included."""
    find = F.pandas_udf(lambda t, n: pd.Series([_starts(*row) for row in zip(t, n)]), "array<int>", F.PandasUDFType.SCALAR)
    return find(text, needle)


def selectors(text: Column, quote: Column) -> Column:
    """The (start, end) of all places that read as the quote if runs of white space are alike.

    Null for a quote that is empty, longer than LONGEST or has white space at an end, or if a place is longer than LONGEST.
    """
    find = F.pandas_udf(lambda t, q: pd.Series([_selectors(*row) for row in zip(t, q)]), "array<struct<start:int,`end`:int>>", F.PandasUDFType.SCALAR)
    return find(text, quote)


def unique_places(quotes: DataFrame, fragments: DataFrame, group: str) -> DataFrame:
    """Quotes (quote_id, group, quote) with the one fragment (fragment_id, group, text) and place of their group that reads so; null if there is none or there are several.

    A quote of the group is held against each of the group's fragments, of which a batch carries few.
    """
    places = quotes.join(fragments.select(group, "fragment_id", "text"), group).withColumn("_places", selectors(F.col("text"), F.col("quote")))
    summed = places.groupBy("quote_id").agg(F.sum(F.coalesce(F.size("_places"), F.lit(0))).alias("n_places"), F.bool_or(F.col("_places").isNull()).alias("_refused"), F.max(F.when(F.size("_places") > 0, F.struct("fragment_id", F.element_at("_places", 1).alias("at")))).alias("_one"))
    one = (F.col("n_places") == 1) & ~F.col("_refused")
    place = F.when(one, F.col("_one"))
    joined = quotes.join(summed, "quote_id", "left")
    return joined.select(*quotes.columns, F.coalesce("n_places", F.lit(0)).alias("n_places"), place["fragment_id"].alias("fragment_id"), place["at"]["start"].alias("start"), place["at"]["end"].alias("end"))


def sealed(manifests: DataFrame, key: str, *cols: str) -> DataFrame:
    """Manifests with the digest and the bytes of their content, and whether these stay within what a receipt may have."""
    body = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    size = json_bytes(*cols)
    return manifests.select(key, F.sha2(body, 256).alias("digest"), size.alias("bytes"), (size <= MOST_BYTES).alias("fits"))


def intact(sealed_manifests: DataFrame, manifests: DataFrame, key: str, *cols: str) -> DataFrame:
    """Whether each sealed manifest still has the digest of its content."""
    now = sealed(manifests, key, *cols).select(key, F.col("digest").alias("_now"))
    return sealed_manifests.join(now, key, "left").withColumn("intact", F.col("digest").eqNullSafe(F.col("_now"))).drop("_now")
