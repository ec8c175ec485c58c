"""Product codes of vectors: integer codebooks by Lloyd's rounds, with exponion search for the nearest entries.

A vector's components become integers and are cut into PARTS parts; each part position has a codebook of ENTRIES
entries. The search for a part starts at its entry of the round before: with u the distance to that entry, no entry
further than 2 u from it can be as near, so only the entries within 2 u are looked at, in the order of a list of
neighbours that is sorted once per round. Distances are exact integers and ties go to the lower index.

A round reads the integer vectors with their codes, writes them with new codes, and sums up each entry's parts task
by task; the driver sees those sums only, which are as many as the codebooks' components.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. Null ids come after all
others, and rows that repeat an id are ordered by their vectors. With fewer than ENTRIES rows the codebooks are as
short. Vectors whose lengths differ or are no multiple of PARTS are filled with zeros at the end. Equal labels are
equal as text, nulls together. An empty table gives an empty result. Components of any size are exact, as long as a
row's error fits a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from factloom.sources.staging import drop_path, staged_path

from .common import bounded_batches, hot_bound, join_counted, release_memory, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def nearest(points: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each point (ties to the lower index), from its entry ``start``."""
    gaps = ((entries[:, None] - entries[None]) ** 2).sum(2)
    order = np.array([[j for j in np.argsort(row, kind="stable") if j != a] for a, row in enumerate(gaps)], dtype=np.intp)
    best = start.copy()
    least = ((points - entries[start]) ** 2).sum(1)
    radius, active = 4 * least, np.arange(len(points))
    for step in range(order.shape[1]):
        at = start[active]
        active = active[gaps[at, order[at, step]] <= radius[active]]
        if not len(active):
            break
        found = order[start[active], step]
        far = ((points[active] - entries[found]) ** 2).sum(1)
        nearer = (far < least[active]) | ((far == least[active]) & (found < best[active]))
        best[active[nearer]], least[active[nearer]] = found[nearer], far[nearer]
    return best, least


def _assigned(rows: DataFrame, books: np.ndarray, wide: bool, last: bool) -> DataFrame:
    """The rows with new codes and errors, and a row of sums (entry by entry, then counts) for each task."""
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("code", "error", "sums") and not (last and f.name == "v")])
    schema = schema.add("code", BinaryType()).add("error", LongType()).add("sums", ArrayType(LongType()))
    target, passed = to_arrow_schema(schema), [f.name for f in schema][:-3]
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if wide else np.int64
        entries = books.astype(kind)
        totals, counts = np.zeros(books.shape, kind), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, parts, width)
            before = [c or bytes(parts) for c in batch.column("code").to_pylist()]
            codes = np.frombuffer(b"".join(before), np.uint8).reshape(n, parts).astype(np.intp)
            error = np.zeros(n, kind)
            for p in range(parts):
                codes[:, p], least = nearest(points[:, p], entries[p], codes[:, p])
                error += least
                np.add.at(totals[p], codes[:, p], points[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=k)
            new = {"code": pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), "error": pa.array([int(e) for e in error], pa.int64()), "sums": pa.nulls(n, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [new[c].cast(target.field(c).type) for c in ("code", "error", "sums")], schema=target)
        if counts.any() and not last:
            sums = pa.array([[int(x) for x in totals.ravel()] + counts.ravel().tolist()], target.field("sums").type)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(target)[:-1]] + [sums], schema=target)
        release_memory()

    return rows.mapInArrow(run, schema)


def _updated(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Each entry as the rounded-down mean of its parts; unused ones stay."""
    summed = state.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    flat = np.zeros(books.size + books.shape[0] * books.shape[1], books.dtype)
    for row in summed:
        flat[row["pos"]] = row["n"]
    totals, counts = flat[: books.size].reshape(books.shape), flat[books.size :].reshape(books.shape[:2])[..., None]
    return np.where(counts > 0, totals // np.maximum(counts, 1), books)


def train(vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """(rows with vec_id, _none, _label, code, error; codebooks by part, entry and position), or None without rows."""
    spark, x = vectors.sparkSession, F.col(column)
    bounded_batches(spark, 4096)
    kept = vectors.filter(x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    grid = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    rows = kept.select("vec_id", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"), grid.alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    if not size["n"]:
        return None
    width = -(-size["width"] // PARTS)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * PARTS) - F.size("v"))))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    # Where squared distances could leave 64 bits, Python's integers are used.
    wide = 32 * width * (size["most"] or 0) ** 2 >= 1 << 63
    books = np.array([r["v"] for r in first], object if wide else np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    state, older = rows.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        path = staged_path(spark, "codes")
        _assigned(state, books, wide, False).write.parquet(path)
        held = spark.read.parquet(path)
        books = _updated(books, held)
        if older:
            drop_path(spark, older)
        state, older = held.filter("sums is null").drop("error", "sums"), path
    final = stage(_assigned(state, books, wide, True).drop("sums"), "codes")
    if older:
        drop_path(spark, older)
    return final, books


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row."""
    trained = train(vectors, column)
    if trained is None:
        fields = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], fields)
    codes, books = trained
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    labels = codes.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    joined = join_counted(codes, stage(labels, "labels"), ["_none", "_label"], "_n", hot_bound(codes.count()))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for compress() over ``embeddings``, round by round; lengths are equal multiples of PARTS."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "flat AS (SELECT rid, len(embedding) // 8 AS w, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM kept)",
        "comps AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, floor(4096 * x::DOUBLE)::BIGINT AS x FROM flat)",
        "b0 AS MATERIALIZED (SELECT part, (rid - 1) AS e, pos, x AS c FROM comps WHERE rid <= 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT rid, part, e, sum((x - c) * (x - c))::BIGINT AS d FROM comps JOIN b{r} USING (part, pos) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, part, min([d, e]) AS best FROM d{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT part, best[2] AS e, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM comps JOIN a{r} USING (rid, part) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, e, pos, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (part, e, pos))")
    return (
        f"WITH {', '.join(steps)}, coded AS (SELECT rid, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY rid) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, "
        f"(SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, pos)) FROM b{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (rid)"
    )
