"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most two of 64 bits agree on one of three blocks of bits. So the distinct
fingerprints are dealt three times, each time by another block, and sorted by Gray rank. Over each run of
those that agree on the block stands a tree: a node keeps the bits that all below it share and that no node
above has, and a search adds up the differences on its way down and drops a node with all below it as soon as
they exceed two. A run of more than MOST_RUN is dealt again, three times, by blocks of its other bits, for
the same reason, and so on, so no task holds more than a bounded run. Each run then gives one link from each
fingerprint to the smallest that it is connected with there, never all pairs; the links' connected components
are found by alternating star contractions.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any
other. Null ids are ignored when the smallest id of a component is sought; a component of such rows alone has
a null id. Repeated rows get one row each. Rows are told apart by two hashes of their id and text where one of
a component is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hot_bound, join_counted, stage, utf8

SHINGLE = 3
LIMIT = 2
SEED = 42
FANOUT = 16
#: Runs are indexed together up to about RUN fingerprints. One of more than MOST_RUN is dealt again by further bits, unless
#: so few are left that it cannot have more than 2 ** LEAST_BITS.
RUN, MOST_RUN, LEAST_BITS = 1 << 15, 1 << 16, 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> int:
    words = utf8(text).lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    # Counting byte values and then their bits is cheaper than unpacking every hash.
    values = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (values @ _BITS).ravel()
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def _prints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    bounded_batches(SparkSession.active())
    return F.pandas_udf(_prints, "long", F.PandasUDFType.SCALAR)(text)


def _gray_rank(x: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


class GrayIndex:
    """A forest over fingerprints in Gray order; runs are given by where they start."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray, fanout: int = FANOUT):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        ands, ors, tops = prints, prints, starts
        levels = [(np.full(len(prints), full), prints)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            ends = np.append(tops[1:], len(ands))
            cuts = np.concatenate([np.arange(a, b, fanout) for a, b in zip(tops, ends)]) if len(tops) else tops
            self.children.append((cuts, np.append(cuts[1:], len(ands))))
            tops = np.searchsorted(cuts, tops)
            ands, ors = np.bitwise_and.reduceat(ands, cuts), np.bitwise_or.reduceat(ors, cuts)
            shared = ~(ands ^ ors)
            levels.append((shared, ands & shared))
            if len(cuts) == len(tops):
                break
        self.roots = tops
        # Each node keeps only the shared bits that its parent does not have.
        self.nodes = []
        for level, (mask, pattern) in enumerate(levels):
            if level < len(self.children):
                first, last = self.children[level]
                mask = mask & ~np.repeat(levels[level + 1][0], last - first)
            self.nodes.append((mask, pattern & mask))

    def search(self, queries: np.ndarray, roots: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of the query, place of a fingerprint) within the limit, where query i searches below root roots[i]."""
        who, node, spent = np.arange(len(queries)), self.roots[roots], np.zeros(len(queries), dtype=np.int64)
        for level in range(len(self.nodes) - 1, -1, -1):
            mask, pattern = self.nodes[level]
            spent = spent + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node])
            near = spent <= limit
            who, node, spent = who[near], node[near], spent[near]
            if level:
                first, last = self.children[level - 1]
                width = last[node] - first[node]
                offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                node = np.repeat(first[node], width) + offset
                who, spent = np.repeat(who, width), np.repeat(spent, width)
        return who, node


def _linked(prints: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For each fingerprint the place of the first one that it is connected with in its run."""
    index, run = GrayIndex(prints, starts), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(prints))))
    label = np.arange(len(prints))
    for at in range(0, len(prints), 4096):
        left, right = index.search(prints[at : at + 4096], run[at : at + 4096], limit)
        ahead = right < left + at
        a, b = left[ahead] + at, right[ahead]
        while True:
            one, other = label[a], label[b]
            apart = one != other
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
            while not np.array_equal(label, further := label[label]):
                label = further
    return label


def _run_links(limit: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1))
            size = np.diff(np.append(np.flatnonzero(new), len(rows)))
            rows = rows[np.repeat(size > 1, size)]
            new = np.append(True, np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1)) if len(rows) else np.zeros(0, bool)
            label = _linked(rows[:, 0].view(np.uint64), np.flatnonzero(new), limit) if len(rows) else np.zeros(0, np.int64)
            moved = label != np.arange(len(rows))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 0]), pa.array(rows[label[moved], 0])], names=["a", "b"])

        for batch in batches:
            held.append(np.ascontiguousarray(np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)))
            if sum(map(len, held)) >= RUN:
                rows = np.concatenate(held)
                last = np.flatnonzero(np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1))
                if len(last):
                    yield close(np.ascontiguousarray(rows[: last[-1] + 1]))
                    rows = rows[last[-1] + 1 :]
                held = [rows]
        if held and sum(map(len, held)):
            yield close(np.ascontiguousarray(np.concatenate(held)))

    return links


def _blocks(free: int, parts: int) -> list[int]:
    """The bits of ``free``, from the highest, in consecutive blocks of about the same size, as masks."""
    bits = [1 << i for i in range(63, -1, -1) if free >> i & 1]
    return [sum(bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    """fp, mask and lead, its bits under the mask; a row for each of the masks."""
    each = prints.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
    return each.withColumn("lead", F.col("fp").bitwiseAND(F.col("mask")))


def links(prints: DataFrame, limit: int = LIMIT, most: int = MOST_RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep every connection of at most ``limit`` bits."""
    everything = (1 << 64) - 1
    masks = _blocks(everything, limit + 1)
    runs, done = _dealt(prints, masks), []
    while True:
        open_ = [m for m in masks if 64 - m.bit_count() > LEAST_BITS]
        sizes = runs.filter(F.col("mask").isin([_signed(m) for m in open_])).groupBy("mask", "lead").agg(F.count("*").alias("n"))
        large = stage(sizes.filter(F.col("n") > most).select("mask", "lead"), "large")
        again = {r["mask"] for r in large.select("mask").distinct().collect()}  # of a few masks
        if not again:
            return reduce(DataFrame.unionByName, [*done, _links_of(runs, limit)])
        done.append(_links_of(runs.join(large, ["mask", "lead"], "left_anti"), limit))
        much = stage(runs.join(large, ["mask", "lead"], "left_semi"), "run")
        deeper = {m: [m | b for b in _blocks(everything & ~m, limit + 1)] for m in open_ if _signed(m) in again}
        runs = reduce(DataFrame.unionByName, [_dealt(much.filter(F.col("mask") == _signed(m)).select("fp"), inner) for m, inner in deeper.items()])
        masks = [m for inner in deeper.values() for m in inner]


def _links_of(runs: DataFrame, limit: int) -> DataFrame:
    ranked = runs.withColumn("rank", F.shiftrightunsigned(_gray_rank(F.col("fp")), 1))
    dealt = ranked.repartition("mask", "lead").sortWithinPartitions("mask", "lead", "rank")
    return dealt.select("fp", "mask", "lead").mapInArrow(_run_links(limit), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of an undirected graph of links (a, b), by large and small stars in turn.

    The smallest neighbour of a node with many links goes to all tasks, so that a star's centre is no task's alone.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    now, before = stage(oriented(edges), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        hot = hot_bound(2 * state[0])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "low")
        large = stage(oriented(join_counted(both, low, ["a"], "n", hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = join_counted(large, low, ["a"], "n", hot).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stage(oriented(small), "edges")


def _rows(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """doc_id, two hashes of id and text, fp (signed), root (the component's smallest fp) and component_id; one row per document."""
    keys = {"k1": F.xxhash64("doc_id", text), "k2": F.xxhash64(F.lit(1), "doc_id", text)}
    rows = stage(docs.select("doc_id", *(c.alias(n) for n, c in keys.items()), fingerprints(F.col(text)).alias("fp")), "prints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    hot = hot_bound(prints.agg(F.sum("n")).first()[0] or 0)
    roots = components(links(prints, limit))
    placed = stage(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "placed")
    ids = stage(placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints")), "components")
    named = stage(join_counted(placed, ids, ["root"], "prints", hot).select("fp", "n", "root", "component_id"), "named")
    return join_counted(rows, named, ["fp"], "n", hot).select("doc_id", "k1", "k2", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fp (signed), root (the component's smallest fp), fingerprint (hexadecimal) and component_id."""
    return _rows(docs, text, limit).select("doc_id", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; one row if several repeat that id."""
    rows = _rows(docs, text, limit).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = rows.groupBy("root", "k1", "k2").agg(F.count("*").alias("_rows")).groupBy("root").agg(F.min(F.struct("k1", "k2", "_rows")).alias("first"))
    stay = first.select("first.*")
    keyed = docs.select(F.struct("*").alias("_doc"), F.xxhash64("doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("_k2"))
    joined = keyed.join(stay, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    alone, repeated = joined.filter("_rows = 1"), joined.filter("_rows > 1").dropDuplicates(["k1", "k2"])
    return alone.unionByName(repeated).select("_doc.*")
