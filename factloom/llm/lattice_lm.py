"""Language-model scores: the marginal likelihood of a text over all its segmentations into subwords.

The subwords are an existing vocabulary; their unigram probabilities come from the training documents, whose
distinct words are segmented by that vocabulary's own rules and counted as often as they occur. A word's
likelihood sums over all its segmentations, by a forward recursion in log space; a character outside the
vocabulary is spelled in byte pieces. Pieces never cross words, so a document's likelihood is the product
over its words and one end. Beside it stands the base score, a smoothed unigram model of whole words.

Words are scored once each. The TOP most frequent words go to all tasks, which also takes the hot words out
of the join; the rest of a document's words meet their scores in a join on the word. Both are exact.

Defined cases: null counts as empty and has the end only. A document without an id counts as held out.
Repeated rows count and are scored once each. With no training document, counts are zero and all pieces are
equally likely. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8
from .encoding import tokenizer_path
from .quality_classifier import fold

FOLDS = 10
SMOOTHING = 0.1
#: The words that go to all tasks: at most so many; of words with more bytes, a 128-bit hash goes.
TOP, TOP_BYTES = 1 << 17, 64
#: A task hands on its counts when it holds so many words.
HELD_WORDS = 300_000
_START = "▁"
_LOG10 = log(10)


class Lattice:
    """Piece probabilities and the forward recursion over all segmentations of a word."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        self.pieces, self.bytes = pieces, bytes_
        self.heads = {p[:n] for p in pieces for n in range(1, len(p))}

    def __call__(self, word: str) -> float:
        text, n = _START + word, len(word) + 1
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        pieces, heads = self.pieces, self.heads
        for i in range(n):
            here = into[i]
            if not here:
                continue
            top = max(here)
            here = top if len(here) == 1 else top + log(sum(exp(x - top) for x in here))
            into[i] = []
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if (p := pieces.get(part)) is not None:
                    into[j].append(here + p)
                elif j == i + 1:
                    into[j].append(here + sum(self.bytes[b] for b in utf8(part)))
                if part not in heads:
                    break
        top = max(into[n])
        return top + log(sum(exp(x - top) for x in into[n]))


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _usable(processor) -> tuple[dict[str, int], list[int]]:
    """Ids of the written pieces, and of the 256 byte pieces."""
    bytes_ = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    marks = set(bytes_)
    return {processor.id_to_piece(i): i for i in range(processor.get_piece_size()) if i not in marks and not processor.is_control(i) and not processor.is_unknown(i)}, bytes_


def _lattice(path: str, counts: dict[int, int], ends: int) -> tuple[Lattice, float]:
    """The lattice and the log probability of the end."""
    written, bytes_ = _usable(_processor(path))
    total = sum(counts.get(i, 0) for i in (*written.values(), *bytes_)) + ends + SMOOTHING * (len(written) + 257)
    of = lambda n: log((n + SMOOTHING) / total)
    return Lattice({p: of(counts.get(i, 0)) for p, i in written.items()}, [of(counts.get(i, 0)) for i in bytes_]), of(ends)


def word_counts(docs: DataFrame, text: str, learn: Column) -> DataFrame:
    """Every word with its count in the documents to learn from (c; 0: it occurs in others only) and in all (n)."""

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
        for batch in batches:
            for body, learns in zip(batch["_text"], batch["_learn"]):
                some = held[bool(learns)]
                for word, n in Counter(utf8(body).lower().split()).items():
                    some[word] = some.get(word, 0) + n
            if len(held[0]) + len(held[1]) >= HELD_WORDS:
                yield from map(_strings, (False, True), held)
                held = {}, {}
        yield from map(_strings, (False, True), held)

    slim = docs.select(F.col(text).alias("_text"), learn.alias("_learn"))
    return map_batches(slim, count, "word string, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _strings(learns: bool, held: dict[bytes, int]) -> dict[str, list]:
    n = list(held.values())
    return {"word": [w.decode("utf-8", "surrogatepass") for w in held], "c": n if learns else [0] * len(n), "n": n}


def piece_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """Occurrences of each piece (a fixed vocabulary) in the words, each counted as often as it occurs."""

    def segment(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        processor = _processor(path)
        sums = np.zeros(processor.get_piece_size(), dtype=np.int64)
        for batch in batches:
            ids = processor.encode(batch["word"], num_threads=1)
            flat = np.fromiter((i for some in ids for i in some), dtype=np.int64)
            np.add.at(sums, flat, np.repeat(np.array(batch["c"], dtype=np.int64), [len(i) for i in ids]))
        found = np.flatnonzero(sums)
        yield {"piece": found.tolist(), "n": sums[found].tolist()}

    rows = map_batches(counts.filter("c > 0"), segment, "piece int, n bigint", rows=4096).groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def _most_frequent(rated: DataFrame) -> DataFrame:
    """The words that occur, in any documents, at least so often that there are TOP of them at most; the bound comes from counts by magnitude, a few hundred rows."""
    step = F.floor(F.log2("n") * 16)
    least, held = inf, 0
    for row in sorted(rated.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        held += row["words"]
        if held > TOP:
            break
        least = row["least"]
    return rated.filter(F.col("n") >= F.lit(least))


def _key(word: bytes) -> bytes:
    return word if len(word) <= TOP_BYTES else b" " + xxhash.xxh3_128_digest(word)


def score(docs: DataFrame, name: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), one row per document."""
    spark, path = docs.sparkSession, tokenizer_path(name)
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    counts = stage(word_counts(docs, text, ~held_out), "words")
    ends = docs.filter(~held_out).count()
    known, total = counts.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, distinct = total + ends, known + (ends > 0)
    pieces = piece_counts(counts, path)
    divisor = log(total + SMOOTHING * (distinct + 1))

    def rate(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        lattice, _ = _lattice(path, pieces, ends)
        for batch in batches:
            yield {"word": batch["word"], "c": batch["c"], "n": batch["n"], "lp": [lattice(w) / _LOG10 for w in batch["word"]]}

    rated = stage(map_batches(counts, rate, "word string, c bigint, n bigint, lp double"), "rated")
    top = map_batches(_most_frequent(rated), lambda batches: ({"key": [_key(utf8(w)) for w in b["word"]], "c": b["c"], "lp": b["lp"]} for b in batches), "key binary, c bigint, lp double").collect()
    base = lambda c: (log(c + SMOOTHING) - divisor) / _LOG10
    shared = spark.sparkContext.broadcast({bytes(r["key"]): (r["c"] > 0, base(r["c"]), r["lp"]) for r in top})
    end = (int(ends > 0), base(ends), _lattice(path, pieces, ends)[1] / _LOG10)

    def look_up(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        table = shared.value
        names = ("rid", "doc_id", "word", "tf", "n_tokens", "n_known", "base_score", "score")
        for batch in batches:
            out: list[tuple] = []
            for rid, doc_id, body in zip(batch["rid"], batch["doc_id"], batch["_text"]):
                words, n_known, base_sum, sum_ = utf8(body).lower().split(), *end
                for word, tf in Counter(words).items():
                    if (got := table.get(_key(word))) is None:
                        out.append((rid, None, word.decode("utf-8", "surrogatepass"), tf, 0, 0, 0.0, 0.0))
                    else:
                        n_known += got[0] * tf
                        base_sum += got[1] * tf
                        sum_ += got[2] * tf
                # A row of the document's own; no word has a space in it, so this one joins with nothing.
                out.append((rid, doc_id, f" {rid}", 0, len(words) + 1, n_known, base_sum, sum_))
            yield dict(zip(names, map(list, zip(*out))))

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(text).alias("_text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(slim, look_up, f"rid bigint, doc_id {id_type}, word string, tf bigint, n_tokens bigint, n_known bigint, base_score double, score double", rows=512)
    rare = F.coalesce(F.log(F.col("c") + SMOOTHING) - divisor, F.lit(0.0)) / _LOG10
    met = found.join(rated, "word", "left").select("rid", "doc_id", "n_tokens", (F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"), (F.col("base_score") + F.col("tf") * rare).alias("base_score"), (F.col("score") + F.col("tf") * F.coalesce("lp", F.lit(0.0))).alias("score"))
    sums = met.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
