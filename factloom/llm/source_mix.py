"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A seeded hash deals the documents of each source into blocks, whose order is thereby a random permutation
of the source. A source's quota is a number of blocks, in as many passes over its permutation as it needs. A
tree over the output shards splits the quotas: each node draws how many of its blocks of each source go left
from a multivariate hypergeometric distribution. Every shard then draws its own stretch of each source's
permuted blocks, disjoint from all others, and rows are shuffled within the shard by a second hash. What the mix
takes is what its shards draw; of the last block of a quota only the documents that the target still has room
for are drawn, and the last of them may be cut at a word, so that the quota holds to the word.

Only one row per source comes to the driver, and MAX_SOURCES bounds the sources. The cut is found by sums
over blocks, then over the cells of the block that it falls into, then over the documents of one cell, so
no window holds more than BLOCKS rows or one cell (a 2 ** -24 share of a source).

Defined cases: a null text has no words; a document without words is never taken. The null source is a
source of its own and comes last. Rows that repeat an id are dealt each by its own text; those that repeat both
are dealt together, and any of them may be the one that is cut. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SHARDS = 16
#: Words that one task of a shard writes; a shard has as many tasks as its words need.
PART_WORDS = 16_000_000
SEED = 20
MAX_SOURCES = 10_000
BLOCKS = 4096


@dataclass(frozen=True)
class Source:
    key: str
    size: int
    target: float
    passes: int
    rest: int


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows with their size in words, the key of their source and their place in the permutation."""
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.withColumns({"_source": _source_key(F.col("source")), "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_place": place, "_block": F.shiftrightunsigned(place, 52), "_cell": F.shiftrightunsigned(place, 40).bitwiseAND(BLOCKS - 1)})


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of the words by weight; what is above the cap is shared anew among the others."""
    budget, found, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = budget / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in over or open_:
            found[i] = float(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        budget -= sum(found[i] for i in over)
        open_ -= set(over)
    return found


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); the columns add up to the quotas."""
    random = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.array(quotas, dtype=np.int64))]
    while nodes:
        start, width, here = nodes.pop()
        if width == 1:
            out[start] = here
            continue
        half = width // 2
        left = random.multivariate_hypergeometric(here, int(here.sum()) * half // width, method="marginals") if len(here) else here
        nodes += [(start, half, left), (start + half, width - half, here - left)]
    return out


def _source_plan(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> list[Source]:
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    ordered = sorted(totals, key=lambda r: (r["_source"] == "", r["_source"]))
    sizes = [r["size"] for r in ordered]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    words = [min(round(t), cap * n) for t, n in zip(wanted, sizes)]
    return [Source(r["_source"], n, t, w // n if n else 0, w % n if n else 0) for r, n, t, w in zip(ordered, sizes, wanted, words)]


def _cuts(rows: DataFrame, level: str, rests: DataFrame) -> dict[str, tuple[int, int]]:
    """For each source, the block or cell in which its rest runs out, and what is left of the rest there."""
    sums = rows.groupBy("_source", level).agg(F.sum("_size").alias("words")).filter("words > 0")
    before = F.sum("words").over(Window.partitionBy("_source").orderBy(level)) - F.col("words")
    hit = sums.withColumn("before", before).join(F.broadcast(rests), "_source").filter("before <= rest AND rest < before + words")
    return {r["_source"]: (r[level], r["rest"] - r["before"]) for r in hit.collect()}


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source: size, target, passes, the cut, and where the stretch of blocks of each shard ends; the last one ends with the quota."""
    spark = rows.sparkSession
    plan = _source_plan(rows, weights, share, cap)
    rests = spark.createDataFrame([(s.key, s.rest) for s in plan], "_source string, rest long")
    blocks = _cuts(rows, "_block", rests)
    inside = spark.createDataFrame([(k, b, rest) for k, (b, rest) in blocks.items()], "_source string, _block long, rest long")
    edge = rows.join(F.broadcast(inside.drop("rest")), ["_source", "_block"], "left_semi")
    cells = _cuts(edge, "_cell", inside.drop("_block"))
    quotas = [s.passes * BLOCKS + (blocks[s.key][0] + 1 if s.rest else 0) for s in plan]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    return spark.createDataFrame(
        [(s.key, s.size, s.target, s.passes, blocks.get(s.key, (-1, 0))[0], *cells.get(s.key, (-1, 0)), [int(x) for x in ends[:, i]]) for i, s in enumerate(plan)],
        "_source string, source_size long, target double, _passes long, _cut_block long, _cut_cell long, _cut_rest long, _ends array<long>",
    )


def draw(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The sized rows with their draws, one for each shard and pass whose stretch has their block: pass, shard, words and the place in the shard's shuffle."""
    known = rows.join(F.broadcast(plan), "_source")
    at_cut = (F.col("_block") == F.col("_cut_block")) & (F.col("_cell") == F.col("_cut_cell")) & (F.col("_size") > 0)
    below = (F.col("_block") < F.col("_cut_block")) | ((F.col("_block") == F.col("_cut_block")) & (F.col("_cell") < F.col("_cut_cell")))
    whole = known.filter(~at_cut).withColumn("_part", F.when(below, F.col("_size")).otherwise(F.lit(0).cast("long")))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_source").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = known.filter(at_cut).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_cut_rest") - before)))
    stretch = lambda p: F.size(F.filter("_ends", lambda end: end <= p * BLOCKS + F.col("_block")))
    in_cut_block = lambda p: (p == F.col("_passes")) & (F.col("_block") == F.col("_cut_block"))
    words = lambda p: F.when(in_cut_block(p), F.col("_part")).otherwise(F.col("_size"))
    one = lambda p: F.struct(p.alias("pass"), stretch(p).alias("shard"), words(p).alias("words"), F.xxhash64(F.lit(seed + 1), p, F.col("_place")).alias("order"))
    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes")), one), lambda d: (d["shard"] < F.size("_ends")) & (d["words"] > 0))
    return whole.unionByName(cut).withColumn("draws", draws)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, draws and taken, the words of all draws; one row per document."""
    rows = stage(sized(docs).select("doc_id", "_source", "source", "_size", "_place", "_block", "_cell"), "sizes")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return draw(rows, plan_mix(rows, **options)).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "draws", taken.alias("taken"))


def _planned(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The sized documents with all their columns in _doc, and their plan."""
    rows = sized(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")))
    return rows, plan_mix(stage(rows.select("doc_id", "_source", "_size", "_place", "_block", "_cell"), "sizes"), **options)


def _drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """_shard, _order and the document; a row per draw. The document at a source's cut comes whole if more than half of it is drawn, else not at all."""
    drawn = draw(rows, plan).withColumn("_draw", F.explode("draws")).filter(2 * F.col("_draw.words") > F.col("_size"))
    return drawn.select(F.col("_draw.shard").alias("_shard"), F.col("_draw.order").alias("_order"), "_doc")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: _shard, _order and the documents' columns; a row per draw."""
    return _drawn(*_planned(docs, **options)).select("_shard", "_order", "_doc.*")


def shard_parts(words: float, shards: int = SHARDS, part_words: int = PART_WORDS) -> int:
    """The tasks that each shard of a mix of so many words is dealt to."""
    return max(1, ceil(words / (shards * part_words)))


def shuffled_shards(docs: DataFrame, part_words: int = PART_WORDS, shards: int = SHARDS, **options) -> DataFrame:
    """The documents of the mix, shard by shard and in shuffled order within: a shard is dealt to tasks of some ``part_words``, each a range of that order."""
    rows, plan = _planned(docs, shards=shards, **options)
    parts = shard_parts(plan.agg(F.sum("target")).first()[0] or 0, shards, part_words)
    part = F.col("_shard") * parts + F.floor(F.shiftrightunsigned("_order", 32) * parts / (1 << 32)).cast("int")
    return _drawn(rows, plan).repartitionById(shards * parts, part).sortWithinPartitions("_order").select("_doc.*")
