"""Token-ID files of patched frame-of-reference blocks.

Documents are sorted by id over range partitions; each partition is a stream of ids, cut into segments that
end with a document, and a segment is a row of the file: blocks of BLOCK ids packed one after another, the
byte offset of each block (so that a block can be read on its own), and where its documents start. A block
keeps its smallest id; the rest is packed at the width, out of those that fixed percentiles of the block
need, that makes the block smallest, and what does not fit the width goes to a list of exceptions. The
container is Parquet, so files are written by Spark's committer and survive lost executors.

Defined cases: null counts as empty and has the end id only. Null ids come first. Rows that repeat an id are
written one after another, in the order of a hash of their texts, over as many ranges as they need. An empty table gives no segments. A document longer
than a segment is one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.sources.staging import staged_path

from .common import map_batches, release_memory
from .encoding import tokenizer_path, unit_encoder

END_ID = 1
BLOCK = 4096
SEGMENT = 1 << 18
PERCENTILES = (50, 75, 90, 95, 98, 100)

SEGMENTS = "part int, segment long, first long, ids long, blocks binary, block_at array<int>, doc_id array<bigint>, doc_tokens array<bigint>"

# Layout of a block: ids u32, smallest u32, width u32, exceptions u32; packed bits, padded to bytes; places of exceptions u32, their values u32.
_HEAD = 4
_BITS16 = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits_needed(values: np.ndarray) -> np.ndarray:
    return _BITS16[values] if int(values.max()) < 1 << 16 else np.frexp(values.astype(np.float64))[1]


def pack(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    below = np.cumsum(np.bincount(_bits_needed(rest), minlength=33))  # ids that need so many bits at most
    sizes = {}
    for p in PERCENTILES:
        width = int(np.searchsorted(below, (len(ids) - 1) * p // 100, "right"))
        sizes[width] = (len(ids) * width + 7) // 8 + 8 * (len(ids) - int(below[width]))
    width = min(sizes, key=lambda w: (sizes[w], w))
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    word = 2 if width <= 16 else 4
    bits = np.unpackbits(rest.astype(f"<u{word}").view(np.uint8).reshape(-1, word), axis=1, bitorder="little")[:, :width]
    head = np.array([len(ids), low, width, len(out)], dtype="<u4")
    return b"".join((head.tobytes(), np.packbits(bits, bitorder="little").tobytes(), out.astype("<u4").tobytes(), rest[out].tobytes()))


def unpack(block: bytes | memoryview) -> np.ndarray:
    n, low, width, n_out = np.frombuffer(block, "<u4", _HEAD).tolist()
    packed = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(block, np.uint8, packed, 4 * _HEAD), count=n * width, bitorder="little")
    word = 2 if width <= 16 else 4
    full = np.zeros((n, 8 * word), dtype=np.uint8)
    full[:, :width] = bits.reshape(n, width)
    ids = np.packbits(full, axis=1, bitorder="little").view(f"<u{word}").ravel().astype("<u4")
    if n_out:
        at, values = np.frombuffer(block, "<u4", 2 * n_out, 4 * _HEAD + packed).reshape(2, n_out)
        ids[at] = values
    return ids + np.uint32(low)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, list[int]]:
    packed = [pack(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    return b"".join(packed), np.cumsum([0, *map(len, packed)])[:-1].tolist()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", end_id: int = END_ID) -> None:
    """Encodes the documents, appends the end id to each, and writes them in ascending order of doc_id."""
    ordered = docs.select("doc_id", F.col(text).alias("_text"), F.xxhash64(text).alias("_hash")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")
    end = np.array([end_id], dtype="<u4").tobytes()
    target = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = unit_encoder(tokenizer, False), TaskContext.get().partitionId()
        segment = first = pending = 0
        ids, names, counts = [], [], []

        def close() -> pa.RecordBatch:
            blocks, at = pack_blocks(np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "segment": segment, "first": first, "ids": pending, "blocks": blocks, "block_at": at, "doc_id": names, "doc_tokens": counts}
            return pa.RecordBatch.from_pylist([row], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pydict()
                for doc_id, got in zip(some["doc_id"], encoder([t or "" for t in some["_text"]])):
                    ids += (got, end)
                    names.append(doc_id)
                    counts.append(len(got) // 4 + 1)
                    pending += counts[-1]
                    if pending >= SEGMENT:
                        yield close()
                        segment, first, pending, ids, names, counts = segment + 1, first + pending, 0, [], [], []
        if names:
            yield close()
        encoder.forget()
        release_memory()

    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, *wanted: Column) -> DataFrame:
    """doc_id, start, n_tokens and, of every document in the files, what is wanted of its ids (little-endian unsigned 32-bit)."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # One row per partition of the files: its ids, and those of all before it.
    before = files.groupBy("part").agg(F.sum("ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def decode(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part, first, blocks, at, names, counts in zip(*(batch[c] for c in ("part", "first", "blocks", "block_at", "doc_id", "doc_tokens"))):
                view = memoryview(blocks)
                ids = np.concatenate([unpack(view[a:b]) for a, b in zip(at, [*at[1:], len(blocks)])]).tobytes()
                starts = np.cumsum([0, *counts])
                yield {"part": [part] * len(names), "first": (starts[:-1] + first).tolist(), "doc_id": names, "n_tokens": counts, "ids": [ids[4 * a : 4 * b] for a, b in zip(starts, starts[1:])]}

    docs = map_batches(files.select("part", "first", "blocks", "block_at", "doc_id", "doc_tokens"), decode, "part int, first bigint, doc_id bigint, n_tokens bigint, ids binary", rows=4)
    kept = docs.select("part", "first", "doc_id", "n_tokens", *(wanted or ("ids",)))
    return kept.join(before, "part").withColumn("start", F.col("before") + F.col("first")).drop("part", "before", "first")


def token_digests(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """Writes the documents' token files, reads them back: doc_id, start, n_tokens and the crc32 of the ids."""
    spark = docs.sparkSession
    path = path or staged_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path(name))
    return read_tokens(spark, path, F.crc32("ids").alias("ids_crc32"))


