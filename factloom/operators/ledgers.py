"""Cost, quota, lease and retention ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000
QUESTIONS_PER_RUN = 10
#: Input and output tokens in micro-dollars.
INPUT_RATE, OUTPUT_RATE = 0.75, 4.5


def micro(col: Column) -> Column:
    """Dollars as whole micro-dollars, rounded half up; null if negative."""
    return F.when(col >= 0, F.round(col.cast("decimal(20,6)") * MICRO).cast("long"))


def cost_rollup(events: DataFrame, *keys: str) -> DataFrame:
    """Succeeded and failed attempts, actual cost, estimates where there is no actual cost, and both together."""
    estimate = F.when(F.col("actual_micro_usd").isNull(), F.coalesce("estimated_micro_usd", F.lit(0))).otherwise(0)
    rolled = events.groupBy(*keys).agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("actual_micro_usd"), F.lit(0)).alias("actual_micro_usd"),
        F.sum(estimate).alias("estimated_micro_usd"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )
    return rolled.withColumn("total_micro_usd", F.col("actual_micro_usd") + F.col("estimated_micro_usd"))


def cost_status(events: DataFrame, run: str) -> DataFrame:
    """Per run with attempts: still pending, estimated or actual. A run without any is told apart in runs.status_view()."""
    flags = events.groupBy(run).agg(F.bool_or(F.col("status") == "pending").alias("pending"), F.bool_or(F.col("actual_micro_usd").isNull()).alias("estimated"))
    return flags.select(run, F.when(F.col("pending"), "estimated_pending").when(F.col("estimated"), "estimated_complete").otherwise("actual_complete").alias("cost_status"))


def provider_costs(events: DataFrame, provider: str = "provider") -> DataFrame:
    """cost_rollup() by provider with the calls' latency; events that are still pending are an error, as their cost is not known."""
    settled = events.withColumn("status", F.when(F.col("status") == "pending", F.raise_error(F.lit("a pending event has no final cost"))).otherwise(F.col("status")))
    return cost_rollup(settled, provider).join(events.groupBy(provider).agg(F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms")), provider)


def merged_costs(old: DataFrame, new: DataFrame, attempt: str, order: str) -> DataFrame:
    """Events after new ones came in: of those with the same attempt the newest, of those without one each full value once."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    last = Window.partitionBy(attempt).orderBy(F.desc("_side"), F.desc(order))
    named = both.filter(F.col(attempt).isNotNull()).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_side")
    return named.unionByName(both.filter(F.col(attempt).isNull()).drop("_side").distinct())


def token_totals(batches: DataFrame, *keys: str) -> DataFrame:
    """Tokens, bytes and the upper bound of the cost of a group's calls: each may be rounded up on its own."""
    sums = batches.groupBy(*keys).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("bytes").alias("bytes"), F.count("*").alias("calls"))
    return sums.withColumn("most_micro_usd", token_cost(F.col("tokens_in"), F.col("tokens_out")) + F.col("calls") - 1)


def unpriced(events: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """Expected (provider, operation) pairs of each run without a priced event."""
    priced = events.filter(F.coalesce("actual_micro_usd", "estimated_micro_usd").isNotNull()).select(run, "provider", "operation").distinct()
    return events.select(run).distinct().join(F.broadcast(expected)).join(priced, [run, "provider", "operation"], "left_anti")


def daily_commitment(reservations: DataFrame, *keys: str) -> DataFrame:
    """Per UTC day and keys: settled amounts, reservations where not settled, and the number of runs."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return reservations.groupBy(day, *keys).agg(F.sum(F.coalesce("settled_micro_usd", "amount_micro_usd")).alias("committed_micro_usd"), F.count("*").alias("runs"))


def fold(rows: DataFrame, key: str, order: tuple[str, ...], start: Callable[[], Any], step: Callable[[Any, Any], Any], result: str) -> DataFrame:
    """Runs ``step(state, row)`` over each key's rows in order and keeps what it returns as a column.

    A key's rows pass through one task in Arrow batches, with the state alone held between them.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {result}"
    column = result.split()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if (now := getattr(row, key)) != last:
                    last, state = now, start()
                out.append(step(state, row))
            yield frame[names].assign(**{column: out})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def admit_budgets(reservations: DataFrame, run_cap: int, day_cap: int, runs_per_day: int) -> DataFrame:
    """Admits or rejects reservations (day, quota_key, run_id, ts, amount) in order; what is rejected takes no budget.

    Every run asked for counts against its quota key's runs of the day, and a run admitted once is admitted again for free.
    """

    def step(state: dict, row: Any) -> str:
        if row.run_id in state["admitted"]:
            return "replayed"
        runs = state["runs"][row.quota_key] = state["runs"].get(row.quota_key, 0) + 1
        if row.amount_micro_usd > run_cap:
            return "over_run_cap"
        if runs > runs_per_day:
            return "over_quota"
        if state["spent"] + row.amount_micro_usd > day_cap:
            return "over_day_cap"
        state["spent"] += row.amount_micro_usd
        state["admitted"].add(row.run_id)
        return "admitted"

    return fold(reservations, "day", ("ts", "run_id"), lambda: {"spent": 0, "runs": {}, "admitted": set()}, step, "decision string")


def admit_uploads(uploads: DataFrame, count_cap: int, bytes_cap: int) -> DataFrame:
    """Admits uploads (quota_day, id, ts, size_bytes) while the day's count and bytes stay in bounds."""

    def step(state: dict, row: Any) -> bool:
        if state["n"] >= count_cap or state["bytes"] + row.size_bytes > bytes_cap:
            return False
        state["n"] += 1
        state["bytes"] += row.size_bytes
        return True

    return fold(uploads, "quota_day", ("ts", "id"), lambda: {"n": 0, "bytes": 0}, step, "admitted boolean")


def settle(reserved: Column, settled: Column, observed: Column, cap: int) -> Column:
    """The settled amount: the greater of the old and the observed one; null if that exceeds the reservation or the cap."""
    return F.when((observed <= reserved) & (observed <= cap) & (observed >= 0), F.greatest(F.coalesce(settled, F.lit(0)), observed))


def limited(rows: DataFrame, key: str, order: tuple[str, ...], most: int = QUESTIONS_PER_RUN) -> DataFrame:
    """Marks the first ``most`` rows of each key as admitted; every row counts."""
    return rows.withColumn("admitted", F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= most)


def attempts(events: DataFrame, attempt: str, order: Column) -> DataFrame:
    """One row per attempt: its first start, and its last settlement if there is one."""
    settled = F.when(F.col("status") != "pending", order)
    return events.groupBy(attempt).agg(F.min_by("ts", order).alias("started_at"), F.coalesce(F.max_by("status", settled), F.lit("pending")).alias("status"), F.max_by("actual_micro_usd", settled).alias("actual_micro_usd"), F.count("*").alias("n_events"))


def leases(beats: DataFrame, key: str, ts: str, lease_ms: int) -> DataFrame:
    """Heartbeats in leases: a beat later than the lease takes a new one. key, fence, first and last beat, beats."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    lapsed = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) > lease_ms * 1000, F.lit(True))
    fenced = beats.withColumn("_new", lapsed.cast("int")).withColumn("fence", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return fenced.groupBy(key, "fence").agg(F.min(ts).alias("first_beat"), F.max(ts).alias("last_beat"), F.count("*").alias("beats"))


def newest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest row of each key."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c != key]), order)
    return rows.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def prune_oldest(rows: DataFrame, ts: str, key: str, cutoff: Column, batch: int) -> DataFrame:
    """What is left once the ``batch`` oldest rows before the cutoff are gone."""
    gone = rows.filter(F.col(ts) < cutoff).orderBy(ts, key).limit(batch).select(key)
    return rows.join(gone, key, "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], digest: str, order: str) -> DataFrame:
    """What becomes of each incoming row: inserted, replayed (the same request is there) or conflict (another one is)."""
    old = existing.select(*keys, F.col(digest).alias("_old")).dropDuplicates(list(keys))
    window = Window.partitionBy(*keys).orderBy(order)
    first = F.first(digest).over(window)
    joined = incoming.withColumns({"_first": first, "_n": F.row_number().over(window)}).join(old, list(keys), "left")
    held = F.coalesce("_old", "_first")
    outcome = F.when(F.col("_old").isNull() & (F.col("_n") == 1), "inserted").when(held == F.col(digest), "replayed").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_first", "_n", "_old")


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Micro-dollars for a call, rounded up."""
    return F.ceil(tokens_in * INPUT_RATE + tokens_out * OUTPUT_RATE).cast("long")


def redacted(key: Column, value: Column, longest: int = 500, kept: int = 120) -> Column:
    """A log value without secrets, and cut if it is long."""
    secret = key.rlike(r"(?i)authorization|cookie|token|secret|signed|source_url|upload_url|raw|markdown|pdf")
    cut = F.concat(F.substring(value, 1, kept), F.lit("…[REDACTED "), (F.length(value) - kept).cast("string"), F.lit(" chars]"))
    return F.when(secret, "[REDACTED]").when(F.length(value) > longest, cut).otherwise(value)


def attempt_id(*parts: Column) -> Column:
    """An id in the form of a UUID of version 5 from the digest of the parts, so that an attempt made again has the same id."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    cut = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.conv(F.conv(cut(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))
