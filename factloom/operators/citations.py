"""Quotes against pages: location, uniqueness, verification and the predicates on verified citations."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import normalised
from factloom.sources.staging import stage

LEAST_NORMALISED = 8
LEAST_REPAIRED = 24
#: Words in a shingle of the blocking key where the quote's document is not known.
SHINGLE = 5
#: Characters that key a quote of one or two words.
GRAM = 4
#: Stands for a page that no document has.
NO_PAGE = -1

_LEXEME = re.compile(r"[^\W_]+|[^\s\w]|_")


def _repaired(page: str | None, quote: str | None) -> bool:
    """Whether the page has the quote once words that were broken in two or three are joined, at least one of them so broken."""
    if not page or not quote or len(quote) < LEAST_REPAIRED:
        return False
    source, wanted = _LEXEME.findall(page), _LEXEME.findall(quote)

    def after(word: str, at: int) -> tuple[int, bool]:
        """Where the source goes on after ``word``, and whether it was broken; -1 if it is not there."""
        if at < len(source) and source[at] == word:
            return at + 1, False
        if word.isalpha() and len(word) >= 4:
            for pieces in (source[at : at + 2], source[at : at + 3]):
                sizes = [len(p) for p in pieces]
                if "".join(pieces) == word and all(map(str.isalpha, pieces)) and 1 in sizes and max(sizes) >= 3:
                    return at + len(pieces), True
        return -1, False

    for start in range(len(source)) if wanted else ():
        at, broken = start, False
        for word in wanted:
            at, here = after(word, at)
            if at < 0:
                break
            broken |= here
        if at >= 0 and broken:
            return True
    return False


def _repair_flags(pages: pd.Series, quotes: pd.Series) -> pd.Series:
    return pd.Series([_repaired(p, q) for p, q in zip(pages, quotes)], dtype=bool)


def verify_citations(candidates: DataFrame, pages: DataFrame, repair: bool = True, compose: bool = True) -> DataFrame:
    """Every candidate (candidate_id, document_sha256, evidence_quote) with the one page that has its quote.

    ``page`` is null and ``method`` is manual_required unless exactly one page of the document qualifies. Candidates with a
    column ``only_page`` that is not null are looked for on that page alone, and not at all if it is NO_PAGE.
    """
    named = ["only_page"] if "only_page" in candidates.columns else []
    quotes = candidates.select("candidate_id", "document_sha256", *named, F.trim("evidence_quote").alias("_quote")).withColumn("_plain", normalised(F.col("_quote"), compose))
    sides = pages.select("document_sha256", "page", F.col("text").alias("_text"), normalised(F.col("text"), compose).alias("_page"))
    pairs = quotes.filter("_quote != ''").join(sides, "document_sha256")
    if named:
        pairs = pairs.filter("only_page IS NULL OR only_page = page")
    pairs = pairs.withColumns({"exact": F.contains("_text", "_quote"), "plain": F.contains("_page", "_plain") & (F.length("_plain") >= LEAST_NORMALISED)})
    if repair:
        # A page that has the quote with words broken has it once all white space is gone; no other page's text reaches Python.
        bare = lambda c: F.regexp_replace(c, r"\s+", "")
        may = ~F.col("exact") & (F.length("_plain") >= LEAST_REPAIRED) & F.contains(bare("_page"), bare("_plain"))
        pairs = pairs.withColumn("_mend", F.when(may, F.col("_page"))).drop("_page", "_text")
        pairs = pairs.withColumn("mended", F.pandas_udf(_repair_flags, "boolean", F.PandasUDFType.SCALAR)("_mend", "_plain"))
    else:
        pairs = pairs.withColumn("mended", F.lit(False))
    one = lambda test: F.count_if(test)
    found = pairs.groupBy("candidate_id").agg(
        one(F.col("exact")).alias("n_exact"),
        one(F.col("mended") & ~F.col("exact")).alias("n_elsewhere"),
        one(F.col("plain") | F.col("mended")).alias("n_plain"),
        F.min(F.when(F.col("exact"), F.col("page"))).alias("exact_page"),
        F.min(F.when(F.col("plain") | F.col("mended"), F.col("page"))).alias("plain_page"),
    )
    exact = (F.col("n_exact") == 1) & (F.col("n_elsewhere") == 0)
    plain = ~exact & (F.col("n_plain") == 1)
    located = found.select("candidate_id", F.when(exact, F.col("exact_page")).when(plain, F.col("plain_page")).alias("page"), F.when(exact, "exact").when(plain, "normalized").alias("_method"))
    return candidates.join(located, "candidate_id", "left").withColumn("method", F.coalesce("_method", F.lit("manual_required"))).withColumn("verified", F.col("page").isNotNull()).drop("_method")


def restricted_to_chunks(candidates: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``only_page`` to candidates with a chunk_id: the page that contains the chunk if just one does, NO_PAGE if the document has no such chunk, else null."""
    named = candidates.filter("chunk_id IS NOT NULL").select("document_sha256", "chunk_id").distinct()
    bodies = named.join(chunks.select("document_sha256", "chunk_id", F.col("text").alias("_chunk")).dropDuplicates(["document_sha256", "chunk_id"]), ["document_sha256", "chunk_id"], "left")
    hits = bodies.join(pages.select("document_sha256", "page", F.col("text").alias("_text")), "document_sha256", "left")
    holds = F.contains("_text", "_chunk")
    only = hits.groupBy("document_sha256", "chunk_id").agg(F.bool_or(F.col("_chunk").isNotNull()).alias("_known"), F.count_if(holds).alias("_n"), F.min(F.when(holds, F.col("page"))).alias("_page"))
    page = F.when(~F.col("_known"), F.lit(NO_PAGE)).when(F.col("_n") == 1, F.col("_page"))
    return candidates.join(only.select("document_sha256", "chunk_id", page.alias("only_page")), ["document_sha256", "chunk_id"], "left")


def verify_at_offsets(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (document_sha256, page, start, end, evidence_quote) with ``verified``: whether that slice of that page, in code points, is the quote to the letter."""
    sides = pages.select("document_sha256", "page", F.col("text").alias("_text"))
    slice_ = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    exact = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (slice_ == F.col("evidence_quote")), F.lit(False))
    return candidates.withColumn("document_sha256", F.lower("document_sha256")).join(sides, ["document_sha256", "page"], "left").withColumn("verified", exact).drop("_text")


def overlapping_texts(citations: DataFrame, relations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pairs of a citation (text) and a relation (relation_text) under the same keys of which one contains the other; a text that is withheld (null) counts by its digest (sha256, relation_sha256)."""
    either = F.contains("text", "relation_text") | F.contains("relation_text", "text")
    same = F.coalesce(F.col("sha256") == F.col("relation_sha256"), F.lit(False))
    return citations.join(relations, list(keys)).filter(F.coalesce(either, same))


def _words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def _keys(rows: DataFrame, id_: str, words: str, run: int) -> DataFrame:
    """(id_, key): the hashes of the runs of so many words, once each."""
    last = F.size(words) - run
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return rows.select(id_, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, F.lit(run))))))).alias("key"))


def _grams(rows: DataFrame, id_: str, text: str, n: int, first: bool) -> DataFrame:
    """(id_, key): the hashes of the runs of n characters, or of the first one, once each."""
    starts = F.sequence(F.lit(1), F.lit(1) if first else F.length(text) - n + 1)
    held = rows.filter(F.length(text) >= n)
    return held.select(id_, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.substring(text, i, F.lit(n)))))).alias("key"))


def _rarest(wanted: DataFrame, held: DataFrame, quote_id: str, page_id: str) -> DataFrame:
    """(quote_id, page_id) of the pages with the quote's rarest key; a quote one of whose keys no page has is nowhere."""
    few = held.join(wanted.select("key").distinct(), "key", "left_semi")
    counts = wanted.join(few.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    best = counts.groupBy(quote_id).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best")).filter("best.n > 0").select(quote_id, F.col("best.key").alias("key"))
    return best.join(few, "key").select(quote_id, page_id)


def locate_quotes(quotes: DataFrame, pages: DataFrame, quote_id: str, page_id: str) -> DataFrame:
    """(quote_id, page_id) of every page that contains a quote, where the quote's document is not known.

    A page that contains a quote has all runs of words from its second word to its last but one: runs of SHINGLE words for
    long quotes, single words for shorter ones. Quotes of one or two words, which may begin and end within words, go by the
    characters that they begin with. Only ids and hashes meet, on the quote's rarest key; then each candidate's two texts are
    fetched and compared. Empty quotes are nowhere.
    """
    asked = quotes.select(quote_id, F.col("text").alias("_quote")).filter("_quote != ''").distinct().withColumn("_all", _words(F.col("_quote")))
    asked = stage(asked.withColumn("_inner", F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0)))), "quotes")
    told = pages.select(page_id, F.col("text").alias("_text"))
    worded = told.select(page_id, F.explode(F.array(_words(F.col("_text")))).alias("_all"))
    size, found = F.size("_inner"), []
    kinds = {r["kind"] for r in asked.select(F.when(size >= SHINGLE, SHINGLE).when(size >= 1, 1).otherwise(-F.least(F.length("_quote"), F.lit(GRAM))).alias("kind")).distinct().collect()}  # of a few kinds
    for kind in sorted(kinds):
        if kind > 0:
            some = asked.filter(size >= SHINGLE if kind == SHINGLE else (size >= 1) & (size < SHINGLE))
            found.append(_rarest(_keys(some, quote_id, "_inner", kind), _keys(worded, page_id, "_all", kind), quote_id, page_id))
        else:
            some = asked.filter((size == 0) & (F.least(F.length("_quote"), F.lit(GRAM)) == -kind))
            found.append(_rarest(_grams(some, quote_id, "_quote", -kind, True), _grams(told, page_id, "_text", -kind, False), quote_id, page_id))
    if not found:
        return asked.join(told).select(quote_id, page_id)  # no quote, so no row
    candidates = stage(reduce(DataFrame.unionByName, found).distinct(), "located")
    both = candidates.join(asked.select(quote_id, "_quote"), quote_id).join(told, page_id)
    return both.filter(F.contains("_text", "_quote")).select(quote_id, page_id).distinct()


def all_verified(citations: str = "citations", document: str | None = None) -> Column:
    """Not empty, each verified with a page and, if given, all from one document."""
    good = F.forall(citations, lambda c: c["verified"] & c["page"].isNotNull() & (F.lit(True) if document is None else c["document_sha256"] == F.lower(F.col(document))))
    return F.coalesce((F.size(citations) > 0) & good, F.lit(False))


def first_of_each(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Keeps the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def overlapping(left: DataFrame, right: DataFrame, keys: tuple[str, ...], width: int = 4096) -> DataFrame:
    """Pairs of spans (start, end) with the same keys that overlap, found through bins of fixed width: a, b columns prefixed l_ and r_."""

    def binned(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
        first, last = F.floor(F.col(prefix + "start") / width), F.floor((F.col(prefix + "end") - 1) / width)
        return named.filter(F.col(prefix + "end") > F.col(prefix + "start")).withColumn("_bin", F.explode(F.sequence(first, last)))

    pairs = binned(left, "l_").join(binned(right, "r_"), [*keys, "_bin"]).filter("l_start < r_end AND l_end > r_start")
    # Of the bins that a pair shares, the one where the later span starts reports it.
    return pairs.filter(F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_bin")
