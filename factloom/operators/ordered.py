"""Running counts, sums and fills over ordered rows, for keys of any size.

Rows are dealt to ranges of (key, order), so that a key with many rows has many ranges. What a range does is summed up,
the few summaries of a key are gone through in order, and each range then knows what comes before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.staging import stage


def ranged(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, written; ranges follow each other in the order of (key, order), and equal places are in one of them."""
    by = [F.col(c) for c in (*key, *order)]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return stage(dealt.withColumn("_range", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """The rows with, for each named amount, its sum over all rows of the key before this one and over all rows of the key.

    The amount ``n`` comes as ``n_before`` and ``n_total``. Null keys are one key.
    """
    marked = ranged(rows.withColumns({f"_{n}": c for n, c in sums.items()}), key, order, ranges)
    own = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = marked.withColumns({f"{n}_before": zero(F.sum(f"_{n}").over(own)) for n in sums})
    parts = marked.groupBy(*key, "_range").agg(*[zero(F.sum(f"_{n}")).alias(f"_{n}") for n in sums])
    earlier, whole = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    offsets = parts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_range").alias("_r"),
        *[x for n in sums for x in (zero(F.sum(f"_{n}").over(earlier)).alias(f"_{n}_offset"), F.sum(f"_{n}").over(whole).alias(f"{n}_total"))],
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(offsets, same)
    return joined.select(*rows.columns, *[x for n in sums for x in ((F.col(f"{n}_before") + F.col(f"_{n}_offset")).alias(f"{n}_before"), f"{n}_total")])


def _next_starts(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each place, where the batch that starts at each place ends: the first place that no longer fits)."""
    before = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.searchsorted(before, before[:-1] + limit, "right") - 1
    return before, np.maximum(ends, np.arange(1, len(sizes) + 1))  # a part that alone exceeds the limit is a batch of its own


def summarise(sizes: np.ndarray, limit: int, first: bool) -> list[tuple[int, int, int]]:
    """What a range does with a batch that is filled to u, as (least, batches, used): the first row with the greatest least <= u holds.

    With u, the first new batch starts at the first place that no longer fits; what follows does not depend on u. So there
    are as many rows as a batch has parts. A range that begins its key, or that fits as a whole, has batches 0 and its own sum as
    used, to which u is added.
    """
    before, ends = _next_starts(sizes, limit)
    n = len(sizes)
    batches, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for at in range(n - 1, -1, -1):
        end = ends[at]
        batches[at], used[at] = (1, before[n] - before[at]) if end == n else (1 + batches[end], used[end])
    if first:
        return [(0, int(batches[0]) - 1, int(used[0]))]
    # A batch starts at the first place whose part no longer fits; of equal bounds the first one counts.
    starts = range(min(n, int(np.searchsorted(before, limit, "right"))))
    out = [(max(0, int(limit - before[at + 1]) + 1), int(batches[at]), int(used[at])) for at in starts]
    return out + ([(0, 0, int(before[n]))] if before[n] <= limit else [])


def after(steps: list[tuple[int, int, int]], used: int, batch: int, first: bool) -> tuple[int, int]:
    """(used, batch) behind a range with such a summary."""
    least, batches, own = max((s for s in steps if s[0] <= used), key=lambda s: s[0])
    return (own if first or batches else used + own), batch + batches


def _fill(sizes: np.ndarray, limit: int, first: bool, used: int, batch: int) -> np.ndarray:
    """The batch of each part of a range that meets a batch filled to ``used``."""
    before, ends = _next_starts(sizes, limit)
    at = int(ends[0]) if first and len(sizes) else max(int(np.searchsorted(before, limit - used, "right")) - 1, 0)
    out = np.full(len(sizes), batch, np.int64)
    while at < len(sizes):
        batch += 1
        out[at : ends[at]] = batch
        at = int(ends[at])
    return out


def packed(rows: DataFrame, key: str, order: tuple[str, ...], size: str, limit: int, ranges: int | None = None) -> DataFrame:
    """The rows with ``batch``, filled in order up to ``limit``, and too_large for a part that alone exceeds it. Null sizes count as nothing."""
    marked = ranged(rows.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")), (key,), order, ranges)
    firsts = marked.groupBy(key).agg(F.min("_range").alias("_first"))
    kind = rows.schema[key].dataType.simpleString()

    def tell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order))
        found = summarise(frame["_size"].to_numpy(np.int64), limit, bool(frame["_begins"].iloc[0]))
        return pd.DataFrame({key: frame[key].iloc[0], "_range": frame["_range"].iloc[0], "steps": [[{"least": m, "batches": b, "used": u} for m, b, u in found]]})

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        used, batch, out = 0, 0, []
        for at, steps in frame.sort_values("_range")[["_range", "steps"]].itertuples(index=False):
            out.append((at, used, batch))
            used, batch = after([(s["least"], s["batches"], s["used"]) for s in steps], used, batch, len(out) == 1)
        return pd.DataFrame(out, columns=["_range", "_used", "_batch"]).assign(**{key: frame[key].iloc[0]})[[key, "_range", "_used", "_batch"]]

    names = list(rows.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order))
        sizes = frame["_size"].to_numpy(np.int64)
        batches = _fill(sizes, limit, bool(frame["_begins"].iloc[0]), int(frame["_used"].iloc[0]), int(frame["_batch"].iloc[0]))
        return frame[names].assign(batch=batches, too_large=sizes > limit)

    begins = marked.withColumnRenamed(key, "_key").join(firsts, F.col("_key").eqNullSafe(F.col(key))).drop(key).withColumnRenamed("_key", key)
    begins = begins.withColumn("_begins", F.col("_range") == F.col("_first")).drop("_first")
    told = begins.groupBy(key, "_range").applyInPandas(tell, f"`{key}` {kind}, _range int, steps array<struct<least: bigint, batches: bigint, used: bigint>>")
    states = stage(told.groupBy(key).applyInPandas(scan, f"`{key}` {kind}, _range int, _used bigint, _batch bigint"), "fills")
    met = begins.join(states.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), "_used", "_batch"), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_k", "_r")
    return met.groupBy(key, "_range").applyInPandas(fill, f"{fields}, batch int, too_large boolean")
