"""Pages into chunks, cores with halos, and bounded fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import trimmed

from .ordered import packed, running

STRIDE, WIDTH = 2800, 3000
CORE, HALO = 2700, 250
FRAGMENT, OVERLAP = 10_000, 500


def _steps(length: Column, stride: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(stride))


def chunks(pages: DataFrame, document: str = "document_sha256", page: str = "page", text: str = "text") -> DataFrame:
    """Overlapping windows over each page's paragraphs, numbered through the document: document, ordinal, chunk_id, text."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n{2,}"), trimmed), lambda p: p != "")
    split = pages.select(document, page, F.posexplode(F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(text))).alias("paragraph", "body"))
    cut = split.select(document, page, "paragraph", F.explode(_steps(F.length("body"), STRIDE)).alias("offset"), "body")
    windows = cut.select(document, page, "paragraph", "offset", trimmed(F.substring("body", F.col("offset") + 1, F.lit(WIDTH))).alias("text")).filter("text != ''")
    ordinal = F.row_number().over(Window.partitionBy(document).orderBy(page, "paragraph", "offset")) - 1
    numbered = windows.withColumn("ordinal", ordinal)
    identity = F.sha2(F.concat_ws("\x00", document, F.col("ordinal").cast("string"), "text"), 256)
    return numbered.select(document, "ordinal", F.substring(identity, 1, 24).alias("chunk_id"), "text")


def cores(pages: DataFrame, text: str = "text", keep: tuple[str, ...] = ("document_sha256", "page")) -> DataFrame:
    """Each page in exclusive cores with a halo of context; an empty page has one empty core."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    cut = pages.select(*keep, length.alias("n"), F.explode(_steps(length, CORE)).alias("core_start"))
    end = F.least(F.col("n"), F.col("core_start") + CORE)
    return cut.select(*keep, (F.col("core_start") / CORE).cast("int").alias("core"), "core_start", end.alias("core_end"), F.greatest(F.lit(0), F.col("core_start") - HALO).alias("context_start"), F.least(F.col("n"), end + HALO).alias("context_end"))


def core_coverage(cores: DataFrame, page_keys: tuple[str, ...], length: str) -> DataFrame:
    """Per page: its cores, and whether they cover it without gap or overlap."""
    order = Window.partitionBy(*page_keys).orderBy("core_start")
    linked = cores.withColumn("joined", F.coalesce(F.lag("core_end").over(order) == F.col("core_start"), F.col("core_start") == 0))
    return linked.groupBy(*page_keys).agg(F.count("*").alias("n_cores"), (F.bool_and("joined") & (F.max("core_end") == F.max(length))).alias("complete"))


def owning_core(start: Column, end: Column) -> Column:
    """The ordinal of the core that owns a span: the one with the span's midpoint. Null for an empty span."""
    return F.when(end > start, F.floor((start + F.floor((end - start - 1) / 2)) / CORE).cast("int"))


def _fragments(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            # The last newline or space at or before the limit, if past the middle.
            stop = max(text.rfind("\n", 0, end + 1), text.rfind(" ", 0, end + 1))
            if stop > at + size / 2:
                end = stop + 1
        if text[at:end].strip():
            yield at, text[at:end]
        at = max(at + 1, end - overlap) if end < len(text) else end


def fragments(documents: DataFrame, key: str = "document_sha256", text: str = "text", size: int = FRAGMENT, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping fragments that end at white space where they can: key, ordinal, fragment_start, text."""
    kind = documents.schema[key].dataType.simpleString()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, at, part) for k, t in zip(frame[key], frame[text]) for i, (at, part) in enumerate(_fragments(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "fragment_start", "text"])

    return documents.select(key, text).mapInPandas(split, f"`{key}` {kind}, ordinal int, fragment_start int, text string")


def balanced_batches(parts: DataFrame, batches: int, package: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Deals the ordered parts of a package into batches whose sizes differ by one at most; the first ones are the larger."""
    at = running(parts, package, order, {"_n": F.lit(1)}, ranges)
    n, small, more = F.col("_n_before"), F.expr(f"_n_total div {batches}"), F.col("_n_total") % batches
    early = n < more * (small + 1)
    batch = F.when(early, F.expr(f"_n_before div (_n_total div {batches} + 1)")).otherwise(more + F.expr(f"(_n_before - _n_total % {batches} * (_n_total div {batches} + 1)) div greatest(_n_total div {batches}, 1)"))
    return at.withColumn("batch", (batch + 1).cast("int")).drop("_n_before", "_n_total")


def packed_batches(parts: DataFrame, package: str, order: tuple[str, ...], size: str, limit: int, ranges: int | None = None) -> DataFrame:
    """Fills batches in order up to ``limit``; a part that alone exceeds it gets a batch of its own, marked too_large."""
    return packed(parts, package, order, size, limit, ranges)


def output_caps(batches: DataFrame, total: int, floor: str, used: str, package: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """What a batch may put out: the total less what earlier batches used and later ones need at least."""
    at = running(batches, package, order, {"_used": F.coalesce(F.col(used), F.lit(0)), "_floor": F.coalesce(F.col(floor), F.lit(0))}, ranges)
    later = F.col("_floor_total") - F.col("_floor_before") - F.coalesce(F.col(floor), F.lit(0))
    return at.withColumn("output_cap", F.greatest(F.lit(total) - F.col("_used_before") - later, F.lit(0))).drop("_used_before", "_used_total", "_floor_before", "_floor_total")


def joined(pages: DataFrame, document: str, order: str, text: str = "text") -> DataFrame:
    """Each document's pages in order, a blank line between them; pages without a text count as empty."""
    page = F.struct(order, F.coalesce(text, F.lit("")).alias("_page"))
    return pages.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["_page"]), "\n\n").alias(text))
