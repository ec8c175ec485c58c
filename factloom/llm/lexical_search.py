"""Ranked lexical search: a forward index in blocks of documents, pruned by the blocks' maxima per term.

The documents are tokenised once into blocks of consecutive documents, which hold the occurrences of the items'
terms document by document. A block's maximum of each term bounds what any of its documents can score for an item.
Each task takes its blocks in the order of an item's bounds and scores whole blocks until the bound falls below the
item's threshold: first that of the best block of every task, over all tasks, then also its own tenth best score.

Items go in groups of at most GROUP_BYTES, so that their vocabulary, statistics and thresholds are bounded; each
group reads the documents once more.

Defined cases: null texts have no terms. Rows of items that repeat an id and its text are one item; each row of
documents is a document, repeated ids included. Equal scores are ordered by doc_id, null ids last. Items without terms, or of which no document has a
term, have no rows; so has an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8

BEST = 10
BLOCK_DOCS = 256
#: Blocks that a task holds at a time.
HELD_BLOCKS = 32
#: Text of items that are asked together, with ROW_BYTES besides for each.
GROUP_BYTES, ROW_BYTES = 4 << 20, 64
#: Lower-cases A-Z and makes a space of each ASCII character that is no letter or digit; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, as UTF-8."""
    return utf8(text).translate(_FOLD).split()


def _packed(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


def _index(docs: DataFrame, vocabulary: dict[bytes, int], text: str, block_docs: int) -> DataFrame:
    """The forward index: a row per block, and one per task with the numbers of documents, terms, and documents of each term."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        seen, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        ids, sizes, terms, counts, at = [], [], [], [], [0]

        def block() -> dict[str, list]:
            return {"ids": [ids], "sizes": [_packed(sizes, np.int64)], "at": [_packed(at, np.int64)], "terms": [b"".join(terms)], "counts": [b"".join(counts)], "n_docs": [None], "n_terms": [None], "df": [None]}

        for batch in batches:
            for doc_id, body in zip(batch["doc_id"], batch["_text"]):
                words = terms_of(body)
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                known = [t for t in map(vocabulary.get, words) if t is not None]
                if not known:
                    continue
                found, tf = np.unique(np.array(known, np.int64), return_counts=True)
                seen[found] += 1
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(_packed(found, np.int32))
                counts.append(_packed(tf, np.int64))
                at.append(at[-1] + len(found))
                if len(ids) == block_docs:
                    yield block()
                    ids, sizes, terms, counts, at = [], [], [], [], [0]
        if ids:
            yield block()
        some = np.flatnonzero(seen)
        yield {"ids": [None], "sizes": [None], "at": [None], "terms": [None], "counts": [None], "n_docs": [n_docs], "n_terms": [n_terms], "df": [[{"term": int(t), "n": int(seen[t])} for t in some]]}

    schema = f"ids array<{id_type}>, sizes binary, at binary, terms binary, counts binary, n_docs bigint, n_terms bigint, df array<struct<term: int, n: bigint>>"
    return stage(map_batches(docs.select("doc_id", F.col(text).alias("_text")), build, schema), "index")


class _Block:
    """Documents with the impact of each of their terms, and the greatest impact of each term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        self.at, self.terms = np.frombuffer(row["at"], np.int64), np.frombuffer(row["terms"], np.int32)
        tf = np.frombuffer(row["counts"], np.int64)
        length = [10 + (90 * n * n_docs) // n_terms for n in np.frombuffer(row["sizes"], np.int64).tolist()]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(np.array(length, np.int64), np.diff(self.at)))
        self.known, inverse = np.unique(self.terms, return_inverse=True)
        self.most = np.zeros(len(self.known), np.int64)
        np.maximum.at(self.most, inverse, self.impact)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.impact * weights[self.terms])))
        return total[self.at[1:]] - total[self.at[:-1]]


class _Items:
    """The items' distinct terms, one after another, and the weight of each term."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.weights, self.terms = weights, [np.array(t, np.int64) for t in items]
        self.flat = np.concatenate([*self.terms, np.zeros(0, np.int64)]).astype(np.int64)
        self.ends = np.cumsum([len(t) for t in items])
        self.own = np.zeros_like(weights)

    def bounds(self, block: _Block) -> np.ndarray:
        """What a document of the block scores at most, for each item."""
        most = np.zeros_like(self.weights)
        most[block.known] = self.weights[block.known] * block.most
        total = np.concatenate(([0], np.cumsum(most[self.flat])))[self.ends]
        return np.diff(total, prepend=0)

    def scores(self, block: _Block, item: int) -> np.ndarray:
        mine = self.terms[item]
        self.own[mine] = self.weights[mine]
        found = block.scores(self.own)
        self.own[mine] = 0
        return found


def _order(pair: tuple) -> tuple:
    score, doc_id = pair
    return (-score, doc_id is None, doc_id if doc_id is not None else 0)


def _best(best: list[tuple], block: _Block, scores: np.ndarray, least: int) -> list[tuple]:
    some = np.flatnonzero(scores >= max(least, 1))
    return sorted(best + [(int(scores[i]), block.ids[i]) for i in some], key=_order)[:BEST]


def best_of(blocks: list[_Block], asked: _Items, best: dict[int, list[tuple]], floor: list[int], whole: bool) -> tuple[dict, list[int]]:
    """The best (score, doc_id) and the threshold of each item after these blocks; each item meets its best block only, unless ``whole``."""
    bounds = np.array([asked.bounds(b) for b in blocks])
    order = np.argsort(-bounds, axis=0, kind="stable")
    for item in np.flatnonzero(bounds.max(axis=0) >= np.array(floor)).tolist():
        for b in order[: None if whole else 1, item]:
            if bounds[b, item] < floor[item]:
                break
            found = best[item] = _best(best.get(item, []), blocks[b], asked.scores(blocks[b], item), floor[item])
            if len(found) == BEST:
                floor[item] = max(floor[item], found[-1][0])
    return best, floor


def _search(index: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, least: list[int] | None) -> DataFrame:
    """(item, score, doc_id): what each task finds; without thresholds, from each item's best block of a group only."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        asked, held = _Items(items, weights), []
        best: dict[int, list[tuple]] = {}
        floor = list(least or [1] * len(items))

        for batch in batches:
            for values in zip(*batch.values()):
                held.append(_Block(dict(zip(batch, values)), n_docs, n_terms))
                if len(held) == HELD_BLOCKS:
                    best, floor = best_of(held, asked, best, floor, least is not None)
                    held = []
        if held and items:
            best, floor = best_of(held, asked, best, floor, least is not None)
        for item, found in best.items():
            yield {"item": [item] * len(found), "score": [s for s, _ in found], "doc_id": [d for _, d in found]}

    return map_batches(index.filter("ids is not null").select("ids", "sizes", "at", "terms", "counts"), run, f"item int, score bigint, doc_id {id_type}", rows=HELD_BLOCKS)


def _ranked(found: DataFrame) -> DataFrame:
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= BEST)


def _group(docs: DataFrame, asked: list, items: DataFrame, text: str, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    terms = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(r["_text"]))] for r in asked]
    index = _index(docs, vocabulary, text, block_docs)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    weights = np.zeros(len(vocabulary), np.int64)
    for row in index.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).collect():
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["n"] + 1)))
    first = _ranked(_search(index, terms, weights, n_docs, n_terms, None)).filter(F.col("rank") == BEST).select("item", "score").collect()
    least = [1] * len(terms)
    for row in first:
        least[row["item"]] = row["score"]
    ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(asked)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return _ranked(_search(index, terms, weights, n_docs, n_terms, least)).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the BEST documents of each item."""
    cost = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES
    slim = items.select("item_id", F.col(text).alias("_text"), cost.alias("_cost")).distinct()
    groups = math.ceil(2 * (slim.agg(F.sum("_cost")).first()[0] or 0) / group_bytes)
    groups = 1 if groups <= 2 else groups
    dealt = slim.withColumn("_group", F.pmod(F.xxhash64("item_id", "_text"), F.lit(groups)))
    found = None
    for g in range(groups):
        asked = dealt.filter(F.col("_group") == g).select("item_id", "_text").collect()
        part = _group(docs, asked, items, text, block_docs)
        part = stage(part, "ranked") if groups > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


ORACLE_SQL = r"""
WITH folded AS (SELECT doc_id, row_number() OVER () AS rid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
terms AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS MATERIALIZED (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT big_n FROM totals) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
norms AS (SELECT rid, 10 + (90 * n * big_n) // big_l AS m FROM lengths, totals),
asked AS (SELECT item_id, row_number() OVER () AS item, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked),
scored AS (SELECT item, item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (rid) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored JOIN folded USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
