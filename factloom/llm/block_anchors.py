"""Repeated word sequences, found by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words. Any WINDOW words hold a whole block, so a
window that occurs twice is anchored by a block of its first occurrence, which one of the rolling windows of BLOCK
words of the other hits. Blocks and rolling windows meet by their hashes; a hit is extended over all windows of WINDOW
words that hold it, as long as the same words stand earlier in the corpus, which gives maximal repeats.

Documents travel in chunks of some CHUNK_WORDS words, and what a chunk asks of the others (anchors, then first places)
goes out once for each distinct value, so that a passage of a third of all documents costs a row per chunk and
nothing is paired. Buckets of hashes grow in number with the corpus, not in size. A document equal to one with a
smaller id is known as a whole, so that groups of copies cost no windows.

Defined cases: null counts as empty. Ids are integers; null ids are one id that comes after all others. Rows that
repeat an id are one document in several texts: of two windows at the same id and start, neither is earlier, so both
stay. Windows never cross rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.staging import drop_path, staged_path

from .common import map_batches, stage, utf8

WINDOW = 20
#: Any WINDOW words hold a whole block, as WINDOW >= 2 * BLOCK - 1.
BLOCK = WINDOW // 2
CHUNK_WORDS = 500_000
#: A chunk ends at this size, too, unless it is one document.
CHUNK_BYTES = 8 << 20
#: Hashes that a bucket gets on average.
BUCKET_KEYS = 2_000_000
HELD_WORDS = 200_000
#: Bits of an anchor's hash besides its bucket: with BUCKET_KEYS in a bucket, one other hash in a thousand hits by chance.
REST = 28
CHUNKS = "part string, chunk bigint, bucket bigint, body binary, keys binary, kinds binary, digests binary, ids binary"
LAST_ID = np.iinfo(np.int64).max
#: Each word of a sequence is multiplied by a power of an odd number, modulo 2**64, so that a stretch is a difference of sums.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of words, and their two hashes by number, for the words of one chunk after another."""

    def __init__(self):
        self.low, self.high = [], []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.low.append(h & 0xFFFFFFFFFFFFFFFF)
        self.high.append(h >> 64)
        self[word] = got = len(self.low) - 1
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self, numbers: list[np.ndarray], high: bool = False) -> np.ndarray:
        return np.array(self.high if high else self.low, np.uint64)[np.concatenate([np.zeros(0, np.int32), *numbers])]

    def shrink(self) -> None:
        if len(self) > HELD_WORDS:
            self.clear()
            self.low, self.high = [], []


def _dense(values: np.ndarray, ascending: bool = False) -> bytes:
    """Values byte by byte, compressed; of ascending ones, the differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _wide(packed: bytes, kind, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(packed[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[4:], n * size, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum(values, dtype=kind) if ascending else values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``base`` and of its inverse."""
    if len(_powers.get(base, ((),))[0]) < n:
        size = max(n, CHUNK_WORDS + 1)
        _powers[base] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    return up[:n], down[:n]


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up)))
    h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Chunk:
    """Documents one after another: their words, ids and lengths."""

    def __init__(self):
        self.ids, self.bodies, self.lengths, self.numbers, self.words, self.bytes = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, words: list[bytes], numbers: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.bodies.append(b" ".join(words))
        self.lengths.append(len(words))
        self.numbers.append(numbers)
        self.words += len(words)
        self.bytes += len(self.bodies[-1])

    def packed(self) -> bytes:
        table = pa.record_batch({"doc_id": pa.array(self.ids, pa.int64()), "body": pa.array(self.bodies, pa.large_binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
            writer.write_batch(table)
        return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_stream(body).read_all()
    return table["doc_id"].to_pylist(), table["body"].to_pylist()


def _ranks(ids: list) -> np.ndarray:
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def _starts(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word offsets of all windows that stay within their document, number of the document of each word)."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    at = np.arange(len(doc))
    return at[at + width <= ends[doc]] if len(doc) else at, doc


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Of equal ranges of hashes, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _anchor_keys(words: np.ndarray, lengths: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bucket and REST bits of the hash, is a reference block) of all rolling windows of BLOCK words."""
    starts, doc = _starts(lengths, BLOCK)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, bool)
    h = rolling(words, BLOCK, _BASES[0])[starts]
    keys = (_bucket(h, buckets) << np.uint64(REST)) | (h & np.uint64((1 << REST) - 1))
    return starts, keys, (starts - (np.cumsum(lengths) - lengths)[doc[starts]]) % BLOCK == 0


def _by_owner(owner: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(owner, its part of each array); equal owners stand together."""
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for at, *parts in zip(np.split(owner, cuts), *(np.split(v, cuts) for v in values)):
        if len(at):
            yield int(at[0]), *parts


def _chunks(docs: DataFrame, buckets: int, text: str, chunk_words: int) -> str:
    """A table in two parts: a row per chunk with its documents, and rows of what it asks of each bucket: its distinct anchors and its documents' digests."""

    def rows(chunk: _Chunk, name: int, words: _Words) -> Iterator[dict[str, list]]:
        empty = {"part": ["asks"], "chunk": [name], "bucket": [None], "body": [None], "keys": [None], "kinds": [None], "digests": [None], "ids": [None]}
        yield empty | {"part": ["body"], "body": [chunk.packed()]}
        _, keys, block = _anchor_keys(words.hashes(chunk.numbers), np.array(chunk.lengths, np.int64), buckets)
        keys = np.sort((keys << np.uint64(1)) | block.astype(np.uint64))
        heads = np.flatnonzero(np.diff(keys >> np.uint64(1), prepend=np.uint64(1 << 63)))
        last = np.append(heads[1:], len(keys)) - 1 if len(heads) else heads
        # 0: no block; 1: a block, met once here; 2: a block that is met again here.
        kinds = ((keys[last] & np.uint64(1)).astype(np.uint8) * (1 + (last > heads))).astype(np.uint8)
        distinct = keys[heads] >> np.uint64(1)
        for bucket, some, kind in _by_owner(distinct >> np.uint64(REST), (distinct & np.uint64((1 << REST) - 1)).astype(np.uint32), kinds):
            yield empty | {"bucket": [bucket], "keys": [_dense(some, True)], "kinds": [_dense(kind)]}
        first: dict[bytes, int] = {}
        for body, n, rank in zip(chunk.bodies, chunk.lengths, _ranks(chunk.ids).tolist()):
            if n >= WINDOW:
                digest = xxhash.xxh3_128_digest(body)
                first[digest] = min(rank, first.get(digest, rank))
        digests = np.frombuffer(b"".join(first), np.uint64).reshape(-1, 2)
        order = np.argsort(digests[:, 0], kind="stable")
        digests, least = digests[order], np.array(list(first.values()), np.int64)[order]
        for bucket, some, rank in _by_owner(_bucket(digests[:, 0], buckets), digests, least):
            yield empty | {"bucket": [bucket], "digests": [some.tobytes()], "ids": [_dense(rank)]}

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        known, chunk, name = _Words(), _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, body in zip(batch["doc_id"], batch["_text"]):
                words = utf8(body).split()
                chunk.add(doc_id, words, known.of(words))
                if chunk.words >= chunk_words or chunk.bytes >= CHUNK_BYTES:
                    yield from rows(chunk, name, known)
                    chunk, name = _Chunk(), name + 1
                    known.shrink()
        if chunk.ids:
            yield from rows(chunk, name, known)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    path = staged_path(docs.sparkSession, "chunks")
    map_batches(slim, cut, CHUNKS, rows=256).write.partitionBy("part").parquet(path)
    return path


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Offsets at which a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _concat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the number of the part of each)."""
    return np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(v) for v in parts])


def _in_buckets(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the columns of each bucket, which hold BUCKET_KEYS hashes on average."""
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)
    target = to_arrow_schema(parsed)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(fn(table.to_pydict()), schema=target)

    return rows.groupBy("bucket").applyInArrow(run, parsed)


def _hits(bucket: dict[str, list]) -> dict[str, list]:
    """For each chunk those of its anchors that are blocks and occur elsewhere as well."""
    keys, owner = _concat([_wide(k, np.uint32, True) for k in bucket["keys"]])
    kinds, _ = _concat([_wide(k, np.uint8) for k in bucket["kinds"]])
    order = np.argsort(keys)
    heads = _heads(keys[order])
    met = np.diff(np.append(heads, len(order)))
    hit = np.zeros(len(keys), bool)
    if len(heads):
        most = np.maximum.reduceat(kinds[order], heads)
        hit[order] = np.repeat((most == 2) | ((most == 1) & (met > 1)), met)
    found = list(_by_owner(owner[hit], keys[hit]))
    return {"chunk": [bucket["chunk"][at] for at, _ in found], "bucket": [bucket["bucket"][at] for at, _ in found], "hits": [_dense(some, True) for _, some in found]}


def _later_copies(bucket: dict[str, list]) -> dict[str, list]:
    """For each chunk the digests of its documents that other chunks have as well, with the smallest id of all."""
    pairs, owner = _concat([np.frombuffer(d, np.uint64).reshape(-1, 2) for d in bucket["digests"]])
    ids, _ = _concat([_wide(i, np.int64) for i in bucket["ids"]])
    order = np.lexsort((ids, pairs[:, 1], pairs[:, 0]))
    heads = _heads(pairs[order, 0], pairs[order, 1])
    met = np.diff(np.append(heads, len(order)))
    first, many = np.empty(len(ids), np.int64), np.zeros(len(ids), bool)
    first[order] = np.repeat(ids[order][heads], met)
    many[order] = np.repeat(met > 1, met)
    found = list(_by_owner(owner[many], pairs[many], first[many]))
    return {"chunk": [bucket["chunk"][at] for at, _, _ in found], "digests": [d.tobytes() for _, d, _ in found], "ids": [_dense(i) for _, _, i in found]}


def _places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal windows together and sorts them by ``a``, where each window's begin in it)."""
    order = np.argsort(a)
    heads = _heads(a[order])
    if len(heads) != len(_heads(a[order], b[order])):
        order = np.lexsort((b, a))
        heads = _heads(a[order], b[order])
    return order, heads


def _windows(path: str, spark: SparkSession, buckets: int) -> DataFrame:
    """A row per chunk with its windows that hold a hit, and rows of what it asks of each bucket: the first place of each distinct window."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    asked = chunks.filter("part = 'asks'")
    hits = _in_buckets(asked.filter("keys is not null").select("chunk", "bucket", "keys", "kinds"), _hits, "chunk bigint, bucket bigint, hits binary")
    copies = _in_buckets(asked.filter("digests is not null").select("chunk", "bucket", "digests", "ids"), _later_copies, "chunk bigint, digests binary, ids binary")
    hits = hits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hits")).alias("hits"))
    copies = copies.groupBy("chunk").agg(F.collect_list(F.struct("digests", "ids")).alias("copies"))
    bodies = chunks.filter("part = 'body'").select("chunk", "body")

    def extend(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        known = _Words()
        for batch in batches:
            for name, body, some, equal in zip(batch["chunk"], batch["body"], batch["hits"], batch["copies"]):
                ids, bodies = _unpacked(body)
                known.shrink()
                numbers = [known.of(b.split()) for b in bodies]
                lengths = np.array([len(w) for w in numbers], np.int64)
                words, ranks = known.hashes(numbers), _ranks(ids)
                at, keys, _ = _anchor_keys(words, lengths, buckets)
                wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_wide(h["hits"], np.uint32, True).astype(np.uint64) | np.uint64(h["bucket"] << REST) for h in some or ())]))
                seen = np.zeros(len(words) + 1, np.int64)
                if len(wanted):
                    seen[at[wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys] + 1] = 1
                seen = np.cumsum(seen)
                whole = np.zeros(len(ids), bool)
                if equal:
                    first = {d[i : i + 16]: least for d, s in ((e["digests"], _wide(e["ids"], np.int64).tolist()) for e in equal) for i, least in zip(range(0, len(d), 16), s)}
                    whole = np.array([n >= WINDOW and first.get(xxhash.xxh3_128_digest(b), r) < r for b, n, r in zip(bodies, lengths.tolist(), ranks.tolist())], bool)
                starts, doc = _starts(lengths, WINDOW)
                if len(starts):
                    starts = starts[(seen[starts + WINDOW - BLOCK + 1] > seen[starts]) & ~whole[doc[starts]]]
                marks = np.zeros(len(words), bool)
                marks[starts] = True
                if len(starts):
                    a, b = (rolling(w, WINDOW, base)[starts] for w, base in zip((words, known.hashes(numbers, True)), _BASES))
                else:
                    a = b = np.zeros(0, np.uint64)
                # Rank of the id among the chunk's, then the offset in the document: places in their order.
                dense = np.unique(ranks, return_inverse=True)
                place = (dense[1][doc[starts]].astype(np.int64) << 32) | (starts - (np.cumsum(lengths) - lengths)[doc[starts]])
                order, heads = _places(a, b)
                met = np.diff(np.append(heads, len(order)))
                least = np.minimum.reduceat(place[order], heads) if len(heads) else place
                number = np.empty(len(order), np.int32)
                number[order] = np.repeat(np.arange(len(heads), dtype=np.int32), met)
                empty = {"chunk": [name], "bucket": [None], "base": [None], "a": [None], "b": [None], "ids": [None], "offsets": [None], "marks": [None], "numbers": [None], "later": [None], "whole": [None]}
                yield empty | {"marks": [_dense(np.packbits(marks))], "numbers": [_dense(number)], "later": [np.packbits(place != least[number]).tobytes()], "whole": [np.packbits(whole).tobytes()]}
                a, b = a[order[heads]], b[order[heads]].astype(np.uint32)
                for bucket, n, *key in _by_owner(_bucket(a, buckets), np.arange(len(a)), a, b, dense[0][least >> 32], (least & 0xFFFFFFFF).astype(np.uint32)):
                    yield empty | {"bucket": [bucket], "base": [int(n[0])], "a": [_dense(key[0], True)], "b": [_dense(key[1])], "ids": [_dense(key[2])], "offsets": [_dense(key[3])]}

    joined = bodies.join(hits, "chunk", "left").join(copies, "chunk", "left")
    return stage(map_batches(joined, extend, "chunk bigint, bucket bigint, base bigint, a binary, b binary, ids binary, offsets binary, marks binary, numbers binary, later binary, whole binary", rows=1), "windows")


def _elsewhere_first(bucket: dict[str, list]) -> dict[str, list]:
    """For each chunk the numbers of its windows whose first place is in another chunk."""
    a, owner = _concat([_wide(x, np.uint64, True) for x in bucket["a"]])
    b, _ = _concat([_wide(x, np.uint32) for x in bucket["b"]])
    ids, _ = _concat([_wide(x, np.int64) for x in bucket["ids"]])
    offsets, _ = _concat([_wide(x, np.uint32) for x in bucket["offsets"]])
    order, heads = _places(a, b)
    met = np.diff(np.append(heads, len(order)))
    lost = np.zeros(len(a), bool)
    if len(heads):
        least = np.repeat(np.minimum.reduceat(ids[order], heads), met)
        later = ids[order] != least
        start = np.where(later, np.uint32(0xFFFFFFFF), offsets[order])
        lost[order] = later | (start != np.repeat(np.minimum.reduceat(start, heads), met))
    begins = np.cumsum([0] + np.bincount(owner, minlength=len(bucket["a"])).tolist())
    found = list(_by_owner(owner[lost], np.flatnonzero(lost)))
    return {"chunk": [bucket["chunk"][at] for at, _ in found], "lost": [_dense((n - begins[at] + bucket["base"][at]).astype(np.int32), True) for at, n in found]}


def _runs(removed: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _decided(docs: DataFrame, text: str, chunk_words: int, out) -> DataFrame:
    """Columns of ``out`` for each document: (words as one text, number of words, removed words or None, its runs of removed words)."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = 1 + size // (6 * BUCKET_KEYS)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    path = _chunks(docs, buckets, text, chunk_words)
    windows = _windows(path, spark, buckets)
    drop_path(spark, f"{path}/part=asks")
    lost = _in_buckets(windows.filter("a is not null").select("chunk", "bucket", "base", "a", "b", "ids", "offsets"), _elsewhere_first, "chunk bigint, lost binary")
    lost = lost.groupBy("chunk").agg(F.collect_list("lost").alias("lost"))
    columns, make = out

    def decide(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for body, marks, numbers, later, whole, gone in zip(*(batch[c] for c in ("body", "marks", "numbers", "later", "whole", "lost"))):
                ids, bodies = _unpacked(body)
                lengths = np.array([b.count(b" ") + 1 if b else 0 for b in bodies], np.int64)
                ends = np.cumsum(lengths)
                starts, numbers = np.flatnonzero(np.unpackbits(_wide(marks, np.uint8))), _wide(numbers, np.int32)
                elsewhere = np.zeros(int(numbers.max(initial=-1)) + 1, bool)
                for g in gone or ():
                    elsewhere[_wide(g, np.int32, True)] = True
                out = elsewhere[numbers] | np.unpackbits(np.frombuffer(later, np.uint8), count=len(starts)).astype(bool)
                steps = np.zeros(int(lengths.sum()) + WINDOW + 1, np.int64)
                np.add.at(steps, starts[out], 1)
                np.add.at(steps, starts[out] + WINDOW, -1)
                covered = np.cumsum(steps) > 0
                copies = np.unpackbits(np.frombuffer(whole, np.uint8), count=len(ids)).astype(bool)
                rows = []
                for doc_id, text, n, end, copy in zip(ids, bodies, lengths.tolist(), ends.tolist(), copies.tolist()):
                    removed = np.ones(n, bool) if copy else covered[end - n : end]
                    rows.append((doc_id, *make(text, n, removed if removed.any() else None)))
                yield dict(zip(["doc_id", *columns], map(list, zip(*rows))))

    bodies = spark.read.schema(CHUNKS).parquet(path).filter("part = 'body'").select("chunk", "body")
    joined = bodies.join(windows.filter("marks is not null").select("chunk", "marks", "numbers", "later", "whole"), "chunk").join(lost, "chunk", "left")
    return map_batches(joined, decide, "doc_id bigint, " + ", ".join(f"{c} {t}" for c, t in columns.items()), rows=1)


def _kept(text: bytes, removed: np.ndarray | None) -> bytes:
    return text if removed is None else b" ".join(w for w, gone in zip(text.split(), removed.tolist()) if not gone)


def repeat_digests(docs: DataFrame, text: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans: a row per document, repeats removed."""
    columns = {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string", "n_spans": "bigint"}
    make = lambda t, n, removed: (n, 0 if removed is None else int(removed.sum()), hashlib.sha256(_kept(t, removed)).hexdigest(), 0 if removed is None else len(_runs(removed)))
    return _decided(docs, text, chunk_words, (columns, make))


def without_repeats(docs: DataFrame, text: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, the kept words joined by spaces, and the removed runs as first and end words."""
    columns = {"kept_text": "string", "removed": "array<struct<first: bigint, `end`: bigint>>"}
    make = lambda t, n, removed: (_kept(t, removed).decode("utf-8", "replace"), [] if removed is None else [{"first": a, "end": b} for a, b in _runs(removed)])
    return _decided(docs, text, chunk_words, (columns, make))


ORACLE_SQL = r"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT rid, doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM split WHERE len(words) >= 20),
hashed AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM windows),
firsts AS (SELECT h, min([doc_id, i]) AS place FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS pos FROM hashed JOIN firsts USING (h) WHERE [doc_id, i] > place),
lists AS (SELECT rid, list(pos) AS removed FROM gone GROUP BY rid),
kept AS (SELECT rid, array_to_string(list_filter(words, lambda w, i: NOT list_contains(removed, i)), ' ') AS t FROM lists JOIN split USING (rid))
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(removed), 0)::BIGINT AS n_removed, sha256(coalesce(t, array_to_string(words, ' '))) AS kept_sha256
FROM split LEFT JOIN lists USING (rid) LEFT JOIN kept USING (rid)
"""
