"""Answers from verified evidence only: the unit with the greatest weighted word overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from factloom.functions.text import leaves_closed_world, question_tokens
from factloom.sources.staging import stage

# Weights by kind of unit, and the score from which an answer is complete.
WEIGHTS = {"claim": 1.2, "requirement": 1.4, "risk": 1.1, "conflict": 1.5}
ANSWERED = 2.4
#: Most questions and units, on average, that meet in one task; an eighth as many of the units with the most words come first, with so many questions.
CELL_QUESTIONS, CELL_UNITS, FIRST_QUESTIONS = 524_288, 32_768, 16_384
#: A large package is cut into so many blocks of units, unless they get smaller than the second number or larger than CELL_UNITS.
BLOCKS, LEAST_UNITS = 24, 2_048
#: The share of its units from which a word is frequent: with all words of its questions in mind, and with the rare ones.
DENSE, FLAGGED = 32, 256
#: Most questions that are judged at once in a cell, and most pairs of them with units.
SLICE, PAIRS = 4_096, 262_144


def answer_units(units: DataFrame) -> DataFrame:
    """The units that may answer: active, verified, and of a kind that the package's submission method permits."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    active = ~F.col("kind").isin("claim", "requirement") | (F.col("status") == "active")
    open_ = F.col("submission_resolved") | ((F.col("kind") == "requirement") & (F.coalesce("category", F.lit("")) != "submission"))
    return units.filter(active & open_ & F.col("has_verified_citation")).withColumn("weight", weights[F.col("kind")])


def _flat(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All words of the rows, and the row of each."""
    words = words.combine_chunks()
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    return words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)


def _sorted_units(units: pa.Table) -> pa.Table:
    return units.take(pc.sort_indices(units, sort_keys=[("ord", "ascending")], null_placement="at_end"))


def _first_best(key: tuple, questions: pa.Table, units: pa.Table, schema: pa.Schema) -> pa.Table:
    """Each question of the cell with its best unit there, or null; words that many units have are added as rows of flags, the others by their lists of units."""
    units = _sorted_units(units)
    n = units.num_rows
    flat, asker = _flat(questions["words"])
    words, ids = np.unique(flat, return_inverse=True)
    bounds = np.searchsorted(asker, np.arange(questions.num_rows + 1))
    best, overlaps, scores = (np.zeros(questions.num_rows, t) for t in (np.int64, np.int64, np.float64))
    if n and len(words):
        flat, owner = _flat(units["words"])
        at = np.searchsorted(words, flat).clip(max=len(words) - 1)
        known = words[at] == flat
        at, owner = at[known], owner[known]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        starts = np.searchsorted(at, np.arange(len(words) + 1))
        many = np.flatnonzero(np.diff(starts) > n // DENSE)
        row = np.full(len(words), -1)
        row[many] = np.arange(len(many))
        flags = np.zeros((len(many), n), np.int16)
        for i, w in enumerate(many):
            flags[i, owner[starts[w] : starts[w + 1]]] = 1
        weights = units["weight"].to_numpy()
        plain = (weights == weights[0]).all()
        for q in range(questions.num_rows):
            mine = ids[bounds[q] : bounds[q + 1]]
            dense = row[mine]
            lists = [owner[starts[w] : starts[w + 1]] for w in mine[dense < 0]]
            counts = flags[dense[dense >= 0]].sum(axis=0, dtype=np.int16)
            if lists:
                counts = counts + np.bincount(np.concatenate(lists), minlength=n)
            top = int(np.argmax(counts if plain else counts * weights))
            best[q], overlaps[q], scores[q] = top, counts[top], counts[top] * weights[top]
    none = overlaps == 0
    columns = [*(questions[c] for c in schema.names[:3]), units["ord"].take(pa.array(best, mask=none)), pa.array(overlaps, mask=none), pa.array(scores, mask=none)]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _least_overlap(bounds: np.ndarray, weight: float) -> np.ndarray:
    """The fewest words that a unit has to share to reach a score, given the greatest weight."""
    if not weight > 0:
        return np.ones(len(bounds), np.int64)
    least = np.ceil(bounds / weight)
    return np.maximum(least - ((least - 1) * weight >= bounds), 1).astype(np.int64)


class _Block:
    """A block's units by word, each word's units ascending; words that many units have as bits too."""

    def __init__(self, units: pa.Table):
        self.n = units.num_rows
        self.weights = units["weight"].to_numpy()
        flat, owner = _flat(units["words"])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order].astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.words, self.starts = flat[starts], np.append(starts, len(flat))
        self.sizes = np.diff(self.starts)
        self.keys = np.repeat(np.arange(len(self.words)), self.sizes) * self.n + self.owner
        many = np.flatnonzero(self.sizes > self.n // FLAGGED)
        self.row = np.full(len(self.words), -1, np.int32)
        self.row[many] = np.arange(len(many))
        self.bits = np.zeros((len(many), (self.n + 7) // 8), np.uint8)
        for i, w in enumerate(many):
            flags = np.zeros(self.n, bool)
            flags[self.owner[self.starts[w] : self.starts[w + 1]]] = True
            self.bits[i] = np.packbits(flags, bitorder="little")

    def has(self, word: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether each unit has the word beside it."""
        row = self.row[word]
        found = (self.bits[row, unit >> 3] >> (unit & 7).astype(np.uint8) & 1).astype(bool) if len(self.bits) else np.zeros(len(word), bool)
        rare = np.flatnonzero(row < 0)
        keys = word[rare] * self.n + unit[rare]
        found[rare] = self.keys[np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)] == keys
        return found

    def better(self, questions: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the question, its best unit here and the overlap, where that reaches the question's score.

        A unit that shares `least` of a question's m words has one of any m - least + 1 of them; those that the fewest units
        have give the candidates, and the others are looked up in turn while the candidate can still reach `least`.
        """
        flat, asker = _flat(questions["words"])
        word = np.searchsorted(self.words, flat).clip(max=len(self.words) - 1)
        known = self.words[word] == flat
        word, asker = word[known], asker[known]
        order = np.lexsort((self.sizes[word], asker))
        word, asker = word[order], asker[order]
        first = np.searchsorted(asker, np.arange(questions.num_rows + 1))
        bounds = questions["score"].to_numpy()
        least = _least_overlap(bounds, self.weights.max())
        rare = np.diff(first) - least + 1
        chosen = np.flatnonzero(np.arange(len(word)) - first[asker] < rare[asker])
        sizes = self.sizes[word[chosen]]
        ends, total = asker[chosen], np.cumsum(sizes)
        found, begin = [], 0
        while begin < len(chosen):
            so_far = total[begin - 1] if begin else 0
            stop = max(np.searchsorted(total, so_far + PAIRS, "right"), begin + 1)
            stop = np.searchsorted(ends, ends[stop - 1], "right")
            part, size = chosen[begin:stop], sizes[begin:stop]
            places = np.repeat(self.starts[word[part]] - (total[begin:stop] - size - so_far), size) + np.arange(size.sum())
            pairs = np.sort(np.repeat(asker[part], size) * self.n + self.owner[places])
            at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            count = np.diff(np.append(at, len(pairs)))
            q, unit = np.divmod(pairs[at], self.n)
            found.append(self._judged(q, unit, count, word, first[q] + rare[q], first[q + 1], least[q], bounds[q]))
            begin = stop
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3

    def _judged(self, q, unit, count, word, at, end, least, bound):  # noqa: PLR0913
        """The best of the candidates of each question: those that still can reach `least` are asked for the next word, from `at` to `end`."""
        done = []
        while len(q):
            open_ = count + end - at >= least
            over = open_ & (at == end)
            done.append((q[over], unit[over], count[over], bound[over]))
            q, unit, count, at, end, least, bound = (x[open_ & ~over] for x in (q, unit, count, at, end, least, bound))
            count = count + self.has(word[at], unit)
            at = at + 1
        q, unit, count, bound = map(np.concatenate, zip(*done))
        score = count * self.weights[unit]
        order = np.lexsort((unit, -score, q))
        order = order[score[order] >= bound[order]]
        best = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])] if len(order) else order
        return q[best], unit[best], count[best]


def _better_in_cell(key: tuple, questions: pa.Table, units: pa.Table, schema: pa.Schema) -> pa.Table:
    """The best unit of a cell for each question of which it reaches the score so far."""
    if not questions.num_rows or not units.num_rows:
        return schema.empty_table()
    units = _sorted_units(units)
    block = _Block(units)
    found = [(i + q, unit, count) for i in range(0, questions.num_rows, SLICE) for q, unit, count in [block.better(questions.slice(i, SLICE))]]
    q, unit, count = map(np.concatenate, zip(*found))
    left = questions.take(pa.array(q))
    columns = [*(left[c] for c in schema.names[:2]), units["ord"].take(pa.array(unit)), pa.array(count), pa.array(count * block.weights[unit])]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _dealt(df: DataFrame, package: str, identity: str, number: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of a part of their package, and the packages that have more than one part."""
    parts = df.groupBy(package).agg(F.ceil(F.count("*") / most).cast("int").alias("n")).filter("n > 1").withColumnRenamed("n", f"{number}_n")
    large = F.coalesce(f"{number}_n", F.lit(1))
    return df.join(F.broadcast(parts), package, "left").withColumn(number, F.pmod(F.xxhash64(identity, "words"), large).cast("int")).drop(f"{number}_n"), parts


def _to_all(df: DataFrame, parts: DataFrame, package: str, number: str) -> DataFrame:
    """Each row once for each part of its package."""
    return df.join(F.broadcast(parts), package, "left").withColumn(number, F.explode(F.sequence(F.lit(0), F.coalesce(f"{number}_n", F.lit(1)) - 1))).drop(f"{number}_n")


def _first_and_others(told: DataFrame, package: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each package about CELL_UNITS / 8 units with the most words, the other units with their blocks, and the packages that have others with the number of blocks."""
    most = max(CELL_UNITS // 8, 1)
    told = told.withColumn("level", F.floor(8 * F.log2(F.size("words"))).cast("int"))
    larger = Window.partitionBy(package).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = told.groupBy(package, "level").agg(F.count("*").alias("n")).withColumn("left", F.lit(most) - F.coalesce(F.sum("n").over(larger), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(package))).filter(F.col("total") > most)
    size = F.least(F.lit(CELL_UNITS), F.greatest(F.ceil(F.col("total") / BLOCKS), F.lit(LEAST_UNITS)))
    levels = levels.select(package, "level", F.when(F.col("left") > 0, F.ceil(F.col("n") / F.col("left"))).alias("share"), F.ceil(F.col("total") / size).cast("int").alias("block_n"))
    told = told.join(F.broadcast(levels), [package, "level"], "left")
    first = F.col("block_n").isNull() | F.coalesce(F.pmod(F.xxhash64("ord"), F.col("share")) == 0, F.lit(False))
    others = told.filter(~first).withColumn("block", F.pmod(F.xxhash64("ord", F.lit("block")), F.col("block_n")).cast("int"))
    plain = (package, "ord", "weight", "words")
    return told.filter(first).select(*plain), others.select(*plain, "block"), levels.select(package, "block_n").distinct()


def best_parts(questions: DataFrame, units: DataFrame, package: str = "package_id", compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each question with the best of the first units, or null, and the units of other blocks that are as good or better.

    Every question meets the units of its package with the most words, and then all others, in cells of some of the questions
    and some of the units, so that a large package is many tasks and a frequent word costs no rows. The score from the first
    units leaves few candidates among the others. Words are held by their 64-bit hashes.
    """
    hashed = lambda c: F.transform(question_tokens(F.col(c), compose), lambda w: F.xxhash64(w))
    told = stage(units.select(package, "ord", F.col("weight").cast("double").alias("weight"), hashed("text").alias("words")), "answer-units").filter((F.size("words") > 0) & F.col("weight").isNotNull())
    first, others, blocks = _first_and_others(told, package)
    asked, parts = _dealt(questions.select(package, "question_id", hashed("question").alias("words")).filter(F.size("words") > 0), package, "question_id", "part", min(CELL_QUESTIONS, FIRST_QUESTIONS))
    named = [questions.schema[c] for c in (package, "question_id")]
    rated = [StructField("ord", units.schema["ord"].dataType), *StructType.fromDDL("overlap bigint, score double")]
    schema, all_words = StructType([*named, *rated]), StructType([*named, told.schema["words"], *rated])
    to_schema, to_all_words = to_arrow_schema(schema), to_arrow_schema(all_words)
    meet = lambda key, left, right: _first_best(key, left, right, to_all_words)
    begun = stage(asked.groupBy(package, "part").cogroup(_to_all(first, parts, package, "part").groupBy(package, "part")).applyInArrow(meet, all_words), "answer-questions")
    open_, parts = _dealt(begun.select(package, "question_id", "words", F.coalesce("score", F.lit(0.0)).alias("score")), package, "question_id", "part", CELL_QUESTIONS)
    open_ = open_.join(F.broadcast(blocks), package).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block_n") - 1))).drop("block_n")
    cell = [package, "part", "block"]
    beat = lambda key, left, right: _better_in_cell(key, left, right, to_schema)
    return begun.drop("words"), open_.groupBy(*cell).cogroup(_to_all(others, parts, package, "part").groupBy(*cell)).applyInArrow(beat, schema)


def best_units(questions: DataFrame, units: DataFrame, package: str = "package_id", compose: bool = True) -> DataFrame:
    """Each question's best unit: question_id, ord, overlap and score. Questions that share no word with a unit are left out."""
    first, better = best_parts(questions, units, package, compose)
    best = F.max_by(F.struct("ord", "overlap", "score"), F.struct("score", -F.col("ord")))
    return first.filter("overlap > 0").unionByName(better).groupBy(package, "question_id").agg(best.alias("best")).select(package, "question_id", "best.*")


def answer(questions: DataFrame, units: DataFrame, compose: bool = True) -> DataFrame:
    """question_id, answerability (answered, partial, not_found) and the answering unit's text."""
    allowed = answer_units(units)
    safe = questions.filter(~leaves_closed_world(F.col("question")))
    found = best_units(safe, allowed, compose=compose).join(allowed.select("package_id", "ord", F.col("text").alias("answer")), ["package_id", "ord"])
    rated = found.withColumn("answerability", F.when(F.col("score") >= ANSWERED, "answered").otherwise("partial"))
    return questions.join(rated.select("package_id", "question_id", "answerability", "answer"), ["package_id", "question_id"], "left").select("package_id", "question_id", F.coalesce("answerability", F.lit("not_found")).alias("answerability"), "answer")
