"""Removing repeated passages with suffix arrays.

Each byte that a string of WIDTH bytes covers goes, if that string also starts anywhere else in the corpus.
Every string of WIDTH bytes has a smallest k-mer by hash, so equal strings have the same one, and the
consecutive strings of a text that share theirs form a piece. A k-mer that only one place of the corpus
selects cannot belong to a repeated string; the pieces of the others are dealt to shards by k-mer. Equal
pieces are counted first and kept once. Each shard gets a suffix array by induced sorting and its permuted
common prefixes, which tell the strings that start more than once. Only a k-mer all of whose pieces are equal,
and have it once, needs no sorting: no two of its strings are equal but those of equal pieces.

The pieces of one k-mer go to one shard up to MOST_BYTES. Beyond, they are cut again by the next longer of KMERS,
whose pieces are shorter and fewer to a key, down to the strings themselves.

Defined cases: null counts as empty; texts shorter than WIDTH bytes lose nothing. Rows are told apart by two
hashes of their id and text; rows that repeat both are separate documents, so they lose all that WIDTH bytes
cover. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_bound, join_counted, map_batches, stage, utf8
from .suffix_arrays import repeated_starts

WIDTH = 200
#: The lengths of k-mers by which pieces are cut, each where those before leave too much to one.
KMERS = (48, 96, 144, 200)
#: A shard's suffix array is built when it has so many bytes; the pieces of one k-mer take it to twice that at most.
SHARD_BYTES, MOST_BYTES = 1_000_000, 1_000_000
#: Longer pieces (of periodic text) are cut, so that none has more strings than this.
MOST_STRINGS = 2048

_SYMBOLS = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ROW = ("k1", "k2")


def kmer_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place, by joining hashes of shorter strings."""
    power, length = _SYMBOLS[raw], 1
    joined, reach = None, 0
    while True:
        if k & 1:
            if joined is None:
                joined, reach = power, length
            else:
                n = len(raw) - reach - length + 1
                joined, reach = joined[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[reach : reach + n], reach + length
        k >>= 1
        if not k:
            break
        power, length = power[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:], 2 * length
    mixed = (joined ^ (joined >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values, have = best(values[:-have], values[have:]), 2 * have
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _smallest(hashes: np.ndarray, width: int, k: int) -> np.ndarray:
    """The hash of the smallest k-mer of each string of ``width`` bytes, from the hashes of all k-mers."""
    return _sliding(np.minimum, hashes, width - k + 1)


def _chosen(hashes: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """The hashes at all places that are smallest for some string."""
    edge = np.zeros(span - 1, np.uint64)
    return hashes[_sliding(np.maximum, np.concatenate([edge, least, edge]), span) == hashes]


def _pieces(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of consecutive strings with the same smallest k-mer start and end."""
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    ends = np.append(starts[1:], len(least))
    if (ends - starts).max() > MOST_STRINGS:
        starts = np.concatenate([np.arange(a, b, MOST_STRINGS) for a, b in zip(starts, ends)])
        ends = np.append(starts[1:], len(least))
    return starts, ends


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """A mask of the bytes that strings of ``width`` bytes from these starts cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def _ranges(starts: np.ndarray) -> list[int]:
    """Sorted places as ranges: first, end, first, end ..."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)] + 1], axis=1).ravel().tolist()


def _selected(width: int, k: int):
    def select(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"k1": [], "k2": [], "chosen": [], "times": []}
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["_text"]):
                data = utf8(text)
                if len(data) >= width:
                    hashes = kmer_hashes(np.frombuffer(data, np.uint8), k)
                    found, counts = np.unique(_chosen(hashes, _smallest(hashes, width, k), width - k + 1).view(np.int64), return_counts=True)
                    for name, value in zip(out, (k1, k2, found, counts)):
                        out[name].append(value)
            yield out

    return select


def _compressed(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    pack = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        yield {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "body": [pack(utf8(t)) for t in batch["_text"]]}


def _cut(data: bytes, width: int, k: int, wanted: list[int] | None = None) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, k-mer, bytes, whether the k-mer is in it once) of the pieces of a text, or of those of the wanted k-mers."""
    hashes = kmer_hashes(np.frombuffer(data, np.uint8), k).view(np.int64)
    least = _smallest(hashes.view(np.uint64), width, k).view(np.int64)
    starts, ends = _pieces(least)
    if wanted is not None:
        keep = np.isin(least[starts], np.array(wanted, dtype=np.int64))
        starts, ends = starts[keep], ends[keep]
    for a, b, h in zip(starts.tolist(), ends.tolist(), least[starts].tolist()):
        yield a, h, data[a : b + width - 1], int((hashes[a : b + width - k] == h).sum()) == 1


def _cut_pieces(width: int, k: int, places: bool):
    """Pieces of the wanted k-mers: their bytes, counted within a batch, or else where they stand."""

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (("k1", "k2", "start", "f1", "f2") if places else ("h", "piece", "once", "n"))}
            seen: dict[tuple[int, bytes, bool], int] = {}
            for k1, k2, body, wanted in zip(batch["k1"], batch["k2"], batch["body"], batch["wanted"]):
                for start, h, piece, once in _cut(unpack(body), width, k, wanted) if wanted else ():
                    if places:
                        for name, value in zip(out, (k1, k2, start, *_digest(piece))):
                            out[name].append(value)
                    else:
                        seen[h, piece, once] = seen.get((h, piece, once), 0) + 1
            if seen:
                for name, values in zip(out, zip(*seen)):
                    out[name] = list(values)
                out["n"] = list(seen.values())
            yield out

    return cut


def _cut_again(width: int, k: int):
    """The pieces of pieces, by longer k-mers: whose (p1, p2), where in them, and their own digests (g1, g2)."""

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("p1", "p2", "at", "g1", "g2", "h", "piece", "once", "n")}
            for h, whole, n in zip(batch["h"], batch["piece"], batch["n"]):
                for start, inner, piece, once in _cut(whole, width, k):
                    key = xxhash.xxh64_intdigest(inner.to_bytes(8, "little", signed=True), h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    for name, value in zip(out, (*_digest(whole), start, *_digest(piece), key, piece, once, n)):
                        out[name].append(value)
            yield out

    return cut


def _digest(piece: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(piece)
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


_FOUND = "f1 bigint, f2 bigint, n bigint, ranges array<int>"


def _shards(width: int):
    """Suffix arrays over pieces that come sorted by k-mer: digest, count and the ranges of repeated starts of each piece that has any."""

    def sort(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"f1": [], "f2": [], "n": [], "ranges": []}
        held: list[tuple[bytes, int]] = []
        same: list[tuple[bytes, int, bool]] = []  # the pieces of one k-mer
        size = 0

        def tell(piece: bytes, n: int, starts: np.ndarray | None = None) -> None:
            ranges = [0, len(piece) - width + 1] if n > 1 else _ranges(starts) if starts is not None else []
            if ranges:
                for name, value in zip(out, (*_digest(piece), n, ranges)):
                    out[name].append(value)

        def end_kmer() -> int:
            if len(same) == 1 and same[0][2]:
                tell(*same[0][:2])
                return 0
            held.extend((piece, n) for piece, n, _ in same)
            return sum(len(piece) for piece, _, _ in same)

        def close() -> None:
            for (piece, n), starts in zip(held, repeated_starts([p for p, _ in held], width)):
                tell(piece, n, starts)
            held.clear()

        last = None
        for batch in batches:
            for h, piece, once, n in zip(batch["h"], batch["piece"], batch["once"], batch["n"]):
                if h != last:
                    size += end_kmer()
                    same, last = [], h
                    if size >= SHARD_BYTES:
                        close()
                        size = 0
                same.append((piece, n, once))
            if len(out["n"]) > 1000:
                yield out
                out = {c: [] for c in out}
        end_kmer()
        if held:
            close()
        yield out

    return sort


def _repeated(pieces: DataFrame, width: int, kmers: tuple[int, ...], most_bytes: int) -> DataFrame:
    """Digest, count and repeated starts of the pieces (h, piece, once, n) that have any; kmers are the lengths left to cut by."""
    large = stage(pieces.groupBy("h").agg(F.sum(F.length("piece")).alias("size"), F.count("*").alias("n")).filter((F.col("size") > most_bytes) & (F.col("n") > 1)).select("h", "n"), "large") if kmers else None
    some = large is not None and not large.isEmpty()
    small = pieces.join(large, "h", "left_anti") if some else pieces
    found = map_batches(small.repartition("h").sortWithinPartitions("h", "piece"), _shards(width), _FOUND, rows=1024)
    if not some:
        return found
    much = join_counted(pieces, large.withColumnRenamed("n", "pieces"), ["h"], "pieces", hot_bound(large.agg(F.sum("n")).first()[0]))
    again = stage(map_batches(much.select("h", "piece", "n"), _cut_again(width, kmers[0]), "p1 bigint, p2 bigint, at int, g1 bigint, g2 bigint, h bigint, piece binary, once boolean, n bigint", rows=256), "cut")
    inner = _repeated(stage(again.groupBy("h", "piece", "once").agg(F.sum("n").alias("n")), "pieces"), width, kmers[1:], most_bytes)
    back = join_counted(again.select("p1", "p2", "at", F.col("g1").alias("f1"), F.col("g2").alias("f2"), F.col("n").alias("mine")), stage(inner, "inner"), ["f1", "f2"], "n", hot_bound(again.agg(F.sum("n")).first()[0]))
    moved = F.transform("ranges", lambda x: x + F.col("at"))
    whole = back.groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.max("mine").alias("n"), F.flatten(F.collect_list(moved)).alias("ranges"))
    return found.unionByName(whole)


def _finish(width: int):
    def finish(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_bytes": [], "removed": [], "kept": []}
            for body, found in zip(batch["body"], batch["found"]):
                data = unpack(body)
                starts = [np.arange(a + f["start"], b + f["start"]) for f in found or () for a, b in zip(f["ranges"][::2], f["ranges"][1::2])]
                gone = _covered(len(data), np.concatenate(starts), width) if starts else np.zeros(len(data), bool)
                out["n_bytes"].append(len(data))
                out["removed"].append(_ranges(np.flatnonzero(gone)))
                out["kept"].append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield out

    return finish


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, kmers: tuple[int, ...] = KMERS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_bytes, removed (ranges of bytes: first, end, first, end ...) and kept (the bytes that stay); one row per document."""
    id_type, k = docs.schema["doc_id"].dataType.simpleString(), kmers[0]
    base = docs.select("doc_id", F.col(text).alias("_text")).withColumns({"k1": F.xxhash64("doc_id", "_text"), "k2": F.xxhash64(F.lit(1), "doc_id", "_text")})
    selected = stage(map_batches(base.select(*_ROW, "_text"), _selected(width, k), "k1 bigint, k2 bigint, chosen array<bigint>, times array<int>", rows=256), "selected")
    places = selected.select(*_ROW, F.explode(F.arrays_zip("chosen", "times")).alias("s")).select(*_ROW, F.col("s.chosen").alias("h"), F.col("s.times").alias("times"))
    twice = stage(places.groupBy("h").agg(F.sum("times").alias("total")).filter("total > 1"), "twice")
    hot = hot_bound(twice.agg(F.sum("total")).first()[0] or 0)
    wanted = stage(join_counted(places.select(*_ROW, "h"), twice, ["h"], "total", hot).groupBy(*_ROW).agg(F.collect_set("h").alias("wanted")), "wanted")
    # All joins read the same columns of the texts in the same way, so that their exchange is made once.
    texts = map_batches(base, _compressed, f"k1 bigint, k2 bigint, doc_id {id_type}, body binary", rows=512)
    candidates = texts.join(wanted, list(_ROW), "left").select(*_ROW, "doc_id", "body", "wanted")
    pieces = map_batches(candidates, _cut_pieces(width, k, False), "h bigint, piece binary, once boolean, n bigint", rows=256)
    counted = stage(pieces.groupBy("h", "piece", "once").agg(F.sum("n").alias("n")), "pieces")
    found = stage(_repeated(counted, width, kmers[1:], most_bytes), "found")
    where = map_batches(candidates, _cut_pieces(width, k, True), "k1 bigint, k2 bigint, start int, f1 bigint, f2 bigint", rows=256)
    placed = join_counted(stage(where, "where"), found, ["f1", "f2"], "n", hot_bound(found.agg(F.sum("n")).first()[0] or 0))
    known = placed.groupBy(*_ROW).agg(F.collect_set(F.struct("start", "ranges")).alias("found"))
    return map_batches(texts.join(known, list(_ROW), "left").select("doc_id", "body", "found"), _finish(width), f"doc_id {id_type}, n_bytes bigint, removed array<int>, kept binary", rows=256)


def repeat_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    length = F.aggregate(F.transform("removed", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return remove_repeats(docs, text).select("doc_id", "n_bytes", length.alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
