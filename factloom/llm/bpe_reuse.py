"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts every text where its content says so, so passages that documents share
fall into equal chunks. A chunk that occurs more than once is encoded once, in the first document that has
it, and its ids go to all its places; rows that repeat an id and its text are one document, encoded once; what lies between shared chunks is encoded where it stands. Where two
pieces meet, the ids around the join are repaired: a window around the join is encoded anew and has to agree
exactly, at both ends, with the ids that stand there; if it does not, it grows.

Texts cross the cluster once, compressed; otherwise only chunk digests and the ids of shared chunks do. Chunks
are equal if their 128-bit hashes are; their bytes are not compared again. The rows of a chunk with more than its
share are dealt to SALTS tasks, to each of which the chunk's ids go.

Defined cases: null counts as empty and has no ids. Rows are told apart by two hashes of their id and text,
so rows that repeat an id are encoded by their own texts, and rows that repeat both get the same ids, each row its own. A text
without any place to cut is one chunk. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_out, hot_bound, join_counted, map_batches, stage, utf8
from .encoding import tokenizer_path, unit_encoder

#: Chunks have about 2 ** CUT_BITS bytes beyond the least.
CUT_BITS = 10
LEAST_CHUNK = 256
#: The first window around a join has so many bytes on each side.
REACH = 96
#: The tokenizer's first step looks less far: at a special token, a contraction and a character beyond.
MARGIN = 24
#: Documents are encoded and given out in batches of so many.
ROWS = 256
#: Rows of a hot chunk meet its ids in so many tasks.
SALTS = 16
_GEAR = np.random.default_rng(2).integers(0, 1 << 32, 256, dtype=np.uint32)
_ROW = ("k1", "k2")
_CHUNK = ("h1", "h2")


def cuts(data: bytes, cut_bits: int = CUT_BITS, least: int = LEAST_CHUNK) -> list[int]:
    """Where chunks start, and the end: 0, ..., len(data). Cuts depend on the 32 bytes before them and never split a character."""
    if not data:
        return [0]
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled = longer
    out = [0]
    for at in (np.flatnonzero(rolled >> np.uint32(32 - cut_bits) == 0) + 1).tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at - out[-1] >= least and at < len(data):
            out.append(at)
    return [*out, len(data)]


def _digest(chunk: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


class Encoder:
    """A byte-level tokenizer with the byte lengths of its ids, and the repair of joins."""

    def __init__(self, path: str):
        self.units = unit_encoder(path, True)
        self.tokenizer = self.units.tokenizer
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for piece, at in vocabulary.items():
            self.lengths[at] = len(piece)  # each character of a piece stands for a byte
        self.decimal = [str(i) for i in range(len(self.lengths))]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.units([t.decode("utf-8", "surrogatepass") for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def join(self, data: bytes, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """The ids of data from those of its pieces (start, end, ids), which cover it in order.

        A window around each join is encoded anew. It agrees with the ids that stand there where one of them has the same bytes
        as one of its own, MARGIN bytes or more from the join and from the window's edge: the tokenizer's first step looks no
        further around a place, and a row of ids is that of its text if every two neighbours are. Where no id agrees on one side,
        the window doubles, up to the text's start and the piece's end.
        """
        done: list[np.ndarray] = []  # the ids of data up to the join
        for start, end, ids in pieces:
            reach, before = REACH, _no_ids()
            while done or len(before):
                before = np.concatenate([_take_off(done, reach - len(before)), before])
                begins = start - np.cumsum(self.lengths[before][::-1])[::-1]
                ahead = ids[:reach]
                ends = start + np.cumsum(self.lengths[ahead])
                left, right = _window_start(data, start - reach, begins), _character(data, start + reach, end)
                fresh = self.encode([data[left:right]])[0]
                stops = left + np.cumsum(self.lengths[fresh])
                spans = stops - self.lengths[fresh], stops
                head = _agreement((begins, begins + self.lengths[before]), spans, left + MARGIN, start - MARGIN) if left else (0, 0)
                tail = _agreement((ends - self.lengths[ahead], ends), spans, start + MARGIN, right - MARGIN) if right < end else (len(ids), len(fresh))
                if head and tail:
                    done += [before[: head[0]], fresh[head[1] : tail[1]]]
                    ids = ids[tail[0] :]
                    break
                reach *= 2
            done.append(ids)
        return np.concatenate(done) if done else _no_ids()


def _no_ids() -> np.ndarray:
    return np.zeros(0, dtype="<u4")


def _take_off(done: list[np.ndarray], count: int) -> np.ndarray:
    """Takes the last ids off the stretches, ``count`` at most."""
    parts: list[np.ndarray] = []
    while done and count > 0:
        part = done.pop()
        if len(part) > count:
            done.append(part[:-count])
            part = part[-count:]
        parts.append(part)
        count -= len(part)
    return np.concatenate(parts[::-1]) if parts else _no_ids()


def _character(data: bytes, at: int, end: int) -> int:
    """The first place from ``at`` where a character starts, or the end."""
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, end)


def _window_start(data: bytes, at: int, begins: np.ndarray) -> int:
    """A place close to ``at`` where a character starts, and an id too if there is such a one."""
    if at <= 0:
        return 0
    for place in begins[np.searchsorted(begins, at) :][:4].tolist():
        if place < at + MARGIN and data[place] & 0xC0 != 0x80:
            return place
    return _character(data, at, len(data))


def _agreement(some: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[int, int] | None:
    """Which of some ids and which of the others, given by where they start and end, is the first that both have between low and high."""
    at = np.minimum(np.searchsorted(others[0], some[0]), len(others[0]) - 1)
    hits = np.flatnonzero((others[0][at] == some[0]) & (others[1][at] == some[1]) & (some[0] >= low) & (some[1] <= high))
    return (int(hits[0]), int(at[hits[0]])) if len(hits) else None


@lru_cache(maxsize=2)
def cached_encoder(path: str) -> Encoder:
    return Encoder(path)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    slim = docs.select("doc_id", F.col(text).alias("_text"))
    return slim.withColumns({"k1": F.xxhash64("doc_id", "_text"), "k2": F.xxhash64(F.lit(1), "doc_id", "_text")})


def _occurrences(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in (*_ROW, "at", *_CHUNK)}
        for k1, k2, text in zip(batch["k1"], batch["k2"], batch["_text"]):
            data = utf8(text)
            places = cuts(data)
            for at, (a, b) in enumerate(zip(places, places[1:])):
                h1, h2 = _digest(data[a:b])
                for name, value in zip(out, (k1, k2, at, h1, h2)):
                    out[name].append(value)
        yield out


def _compressed(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    pack = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        yield {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "body": [pack(utf8(t)) for t in batch["_text"]]}


def encode(docs: DataFrame, finish: Callable[[Encoder, np.ndarray], tuple], columns: str, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id and what ``finish`` makes of each document's ids, in ``columns``."""
    base = _keyed(docs, text)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    places = stage(map_batches(base.select(*_ROW, "_text"), _occurrences, "k1 bigint, k2 bigint, at int, h1 bigint, h2 bigint"), "chunks")
    place = F.struct(*_ROW, "at")
    # A repeated row has the same places, so its chunks are not shared for that.
    shared = stage(places.groupBy(*_CHUNK).agg(F.count("*").alias("n"), F.min(place).alias("owner"), F.max(place).alias("last")).filter("owner < last").drop("last"), "shared")
    hot = hot_bound(shared.agg(F.sum("n")).first()[0] or 0)
    own = F.col("owner") == place
    salt = F.when(F.col("n") > hot, F.pmod(F.xxhash64(*_ROW, "at"), F.lit(SALTS))).otherwise(0).cast("int")
    mine = stage(join_counted(places, shared, list(_CHUNK), "n", hot).select(*_ROW, "at", *_CHUNK, own.alias("own"), salt.alias("salt")), "reused")
    salts = F.broadcast(shared.filter(F.col("n") > hot).select(*_CHUNK, F.sequence(F.lit(0), F.lit(SALTS - 1)).alias("salts")))
    texts = map_batches(base, _compressed, f"k1 bigint, k2 bigint, doc_id {id_type}, body binary", rows=512)
    texts = texts.groupBy(*_ROW).agg(F.first("doc_id").alias("doc_id"), F.first("body").alias("body"), F.count("*").alias("copies"))
    unpack = lambda body: zstandard.ZstdDecompressor().decompress(body)

    def encode_owned(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encoder = cached_encoder(tokenizer)
        for batch in batches:
            chunks = {}
            for body, wanted in zip(batch["body"], batch["owned"]):
                if not wanted:
                    continue
                data = unpack(body)
                start = cuts(data)
                chunks.update({_digest(c): c for c in (data[start[at] : start[at + 1]] for at in wanted)})
            ids = encoder.encode(list(chunks.values()))
            yield {"h1": [h[0] for h in chunks], "h2": [h[1] for h in chunks], "ids": [i.tobytes() for i in ids]}
        encoder.units.forget()

    def assemble(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encoder = cached_encoder(tokenizer)
        names = [c.split()[0] for c in columns.split(", ")]
        for batch in batches:
            jobs, fresh = [], []
            for body, parts in zip(batch["body"], batch["parts"]):
                data = unpack(body)
                known = {p["at"]: np.frombuffer(p["ids"], "<u4") for p in parts or ()}
                start = cuts(data) if known else [0, len(data)]
                pieces: list[list] = []
                for at, (a, b) in enumerate(zip(start, start[1:])):
                    if at in known:
                        pieces.append([a, b, known[at]])
                    elif pieces and pieces[-1][2] is None:
                        pieces[-1][1] = b
                    else:
                        pieces.append([a, b, None])
                todo = [p for p in pieces if p[2] is None]
                fresh += [(p, data[p[0] : p[1]]) for p in todo]
                jobs.append((data, pieces))
            for (piece, _), ids in zip(fresh, encoder.encode([t for _, t in fresh])):
                piece[2] = ids
            rows = [finish(encoder, encoder.join(data, [tuple(p) for p in pieces])) for data, pieces in jobs]
            yield from given_out({"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}, batch["copies"], ROWS)
        encoder.units.forget()

    owned = mine.filter("own").groupBy(*_ROW).agg(F.collect_set("at").alias("owned"))
    # Both joins read the same columns in the same way, so that the texts' exchange is made once and used twice.
    tokens = map_batches(texts.join(owned, list(_ROW), "left").select("doc_id", "body", "copies", "owned"), encode_owned, "h1 bigint, h2 bigint, ids binary", rows=ROWS).dropDuplicates(list(_CHUNK))
    dealt = tokens.join(salts, list(_CHUNK), "left").withColumn("salt", F.explode(F.coalesce("salts", F.array(F.lit(0))))).drop("salts")
    parts = mine.select(*_ROW, "at", *_CHUNK, "salt").join(dealt, [*_CHUNK, "salt"]).groupBy(*_ROW).agg(F.collect_set(F.struct("at", "ids")).alias("parts"))
    return map_batches(texts.join(parts, list(_ROW), "left").select("doc_id", "body", "copies", "parts"), assemble, f"doc_id {id_type}, {columns}", rows=ROWS)


def token_ids(docs: DataFrame, name: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    return encode(docs, lambda encoder, ids: (ids.tobytes(), encoder.decode(ids)), "ids binary, decoded string", tokenizer_path(name), text)


def _digests(encoder: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
    decimal = ",".join(map(encoder.decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def token_digests(docs: DataFrame, name: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encode(docs, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", tokenizer_path(name), text)
