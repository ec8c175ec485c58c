"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and pairs of words, in two views: as they are (A-Z lower-cased) and by shape
(case, digits and marks, and whether a word repeats the one before it). Each is hashed into 2 ** BITS places
with log counts, scaled to length one per view. Training reads a bounded sample of labelled documents: the
SAMPLE ids with the smallest seeded hashes, one label and one text each, in further passes where there are fewer. A score
is the logistic of a sparse dot product with the weights.

Defined cases: a null or empty text has the bias feature only. Rows of labels without an id or a label are
left out of training; if none is left, all scores are one half. Of several labels of an id the largest counts, of
several texts the one that sorts first. A document without an id counts as held out. Repeated rows get the same
score. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, bounded_batches, release_memory, stage

BITS = 18
#: The bound on the labelled documents that training reads.
SAMPLE = 16_000
PASSES = 40
THRESHOLD = 0.3
FOLDS = 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05

#: Labelled rows are ordered by hashes of so many bits, which are told apart so many bits at a time.
ORDER_BITS, STEP_BITS = 60, 12

_LETTERS = re.compile(r"[^\W\d_]+")
_MEMO_SIZE = 100_000


def _shape(word: str) -> str:
    """Letters become A, a or Aa by their case, digits 0; runs of three or more like marks become two."""
    cased = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
    return re.sub(r"(\W)\1{2,}", r"\1\1", re.sub(r"\d+", "0", cased))[:12]


class Features:
    """Feature places and values of texts; remembers the hashes of words it has met."""

    def __init__(self, bits: int = BITS):
        self.bits, self.memo = bits, {}

    def _word(self, word: str) -> tuple[int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= _MEMO_SIZE:
                self.memo.clear()
            got = self.memo[word] = (crc32(word.lower().encode("utf-8", "surrogatepass")), crc32(_shape(word).encode("utf-8", "surrogatepass"), 7))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = WORDS.findall(text or "")
        places, values = [np.zeros(1, np.int64)], [np.ones(1)]
        if words:
            hashed = np.array([self._word(w) for w in words], dtype=np.uint64)
            same = (hashed[1:, 0] == hashed[:-1, 0]).astype(np.uint64)
            for view, salt in ((0, np.uint64(0)), (1, np.uint64(0x9E3779B97F4A7C15))):
                one = (hashed[:, view] + salt) * np.uint64(0xBF58476D1CE4E5B9)
                pair = (one[:-1] * np.uint64(0x94D049BB133111EB)) ^ (hashed[1:, view] + (same if view else np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93)
                found, counts = np.unique(np.concatenate([one, pair * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(64 - self.bits), return_counts=True)
                weight = np.log1p(counts)
                places.append(found.astype(np.int64))
                values.append(weight / np.sqrt((weight * weight).sum()))
        return np.concatenate(places), np.concatenate(values)


class Leader:
    """Follow-the-regularised-leader state: sums of gradients less what the weights have moved, and of squares."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        now = self.weights(places)
        step = (1 / (1 + np.exp(-np.clip(now @ values, -35, 35))) - label) * values
        moved = (np.sqrt(self.n[places] + step * step) - np.sqrt(self.n[places])) / ALPHA
        np.add.at(self.z, places, step - moved * now)
        np.add.at(self.n, places, step * step)


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest _order (0 <= _order < 2 ** 60), all if there are no more; one fewer if the last two tie.

    The bound is found digit by digit: each step counts the rows by the next STEP_BITS bits, within the class that the bound
    falls into, so at most 2 ** STEP_BITS counts come to the driver however many rows there are.
    """
    low, need = 0, most
    for shift in range(ORDER_BITS - STEP_BITS, -1, -STEP_BITS):
        step = F.shiftrightunsigned("_order", shift)
        within = rows.filter((F.col("_order") >= low) & (F.col("_order") < low + (1 << (shift + STEP_BITS))))
        held = 0
        for row in sorted(within.groupBy(step.alias("step")).count().collect(), key=lambda r: r["step"]):
            if held + row["count"] > need:
                low, need = row["step"] << shift, need - held
                break
            held += row["count"]
        else:
            return rows
        if not need:
            break
    return rows.filter(F.col("_order") < low)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", bits: int = BITS, sample: int = SAMPLE, held_out: bool = True) -> np.ndarray:
    """The weights. One task makes the updates in order; what it reads is bounded by ``sample`` rows in all passes together."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter("doc_id IS NOT NULL AND _label IS NOT NULL")
    usable = usable.filter(fold(F.col("doc_id"), FOLDS) != 0) if held_out else usable
    # One row per id, whatever the labels repeat; of the texts under an id, the smallest.
    one = usable.groupBy("doc_id").agg(F.max("_label").alias("_label")).withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 64 - ORDER_BITS))
    chosen = _bounded(stage(one, "labelled"), sample)
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label", "_order").agg(F.min("_text").alias("_text"))
    passes = min(PASSES, max(1, sample // max(1, chosen.count())))
    again = rows.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).withColumn("_order", F.xxhash64("_pass", "_order"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, leader = Features(bits), Leader(1 << bits)
        for frame in frames:
            for body, y in zip(frame["_text"], frame["_label"]):
                leader.learn(*features(body), int(y))
        weights = leader.weights(slice(None)).astype(np.float32)
        kept = np.flatnonzero(weights)
        del features
        yield pd.DataFrame({"places": [kept.astype(np.int32).tobytes()], "weights": [weights[kept].tobytes()]})

    model = again.select("_text", "_label", "_pass", "_order").repartition(1).sortWithinPartitions("_pass", "_order").select("_text", "_label").mapInPandas(fit, "places binary, weights binary").collect()
    weights = np.zeros(1 << bits, dtype=np.float32)
    for part in model:
        weights[np.frombuffer(part["places"], np.int32)] = np.frombuffer(part["weights"], np.float32)
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", bits: int = BITS) -> Column:
    """A column with the score of each text; the weights are of a fixed size, 2 ** bits floats."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, known = Features(bits), shared.value
        for part in parts:
            sums = np.array([known[p] @ v for p, v in map(features, part)], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
        del features
        release_memory()

    return scored(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted."""
    scored = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score(docs, train(docs, labels, text=text), text).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.filter(score(docs, train(docs, labels, text=text), text) >= THRESHOLD)
