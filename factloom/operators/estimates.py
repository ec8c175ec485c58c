"""Estimated infrastructure costs of a run, as rows of micro-dollars rounded up, a quarter added for contingencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices in dollars and the resources that a run may take at most.
CONTINGENCY, MICRO = 1.25, 1_000_000
EVENTS, FUNCTION_ATTEMPTS, ATTEMPT_SECONDS = 1000, 24, 300
CPU_HOUR, MEMORY_GIB_HOUR, MEMORY_GIB, INVOCATION = 0.221, 0.0183, 4, 0.60 / 1_000_000
EVENT, EVENT_BYTES, WRITTEN_GB, RETAINED_GB_MONTH, RETENTION_DAYS = 0.02 / 1000, 64 * 1024, 0.50, 0.50, 7
QUEUE_OPERATIONS, QUEUE_OPERATION = 10, 0.96 / 1_000_000
DATABASE_UNIT_HOUR, DATABASE_BASE_MINUTES, DATABASE_GIB, DATABASE_GIB_MONTH = 0.222, 10, 5 / 1024, 0.55
DOCUMENT_BYTES, BUCKET_GIB_MONTH, BUCKET_MINUTES = 25 * 1024 * 1024, 0.015, 30
OPERATIONS = {"platform": ("compute", "events", "data_written", "data_retained", "queue"), "database": ("postgres",), "bucket": ("storage",)}


def _micro(dollars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(dollars * CONTINGENCY * MICRO)).cast("long")


def infrastructure_costs(runs: DataFrame) -> DataFrame:
    """A row per run (run_id, documents, database_units, ttl_hours, bucket) and operation: provider, operation, estimated_micro_usd."""
    written = EVENTS * EVENT_BYTES / 1_000_000_000
    dollars = {
        "compute": F.lit(FUNCTION_ATTEMPTS * ATTEMPT_SECONDS / 3600 * (CPU_HOUR + MEMORY_GIB * MEMORY_GIB_HOUR) + EVENTS * INVOCATION),
        "events": F.lit(EVENTS * EVENT),
        "data_written": F.lit(written * WRITTEN_GB),
        "data_retained": F.lit(written * RETAINED_GB_MONTH) * ((F.col("ttl_hours") / 24 + RETENTION_DAYS) / 30),
        "queue": F.lit(EVENTS * QUEUE_OPERATIONS * QUEUE_OPERATION),
        "postgres": F.col("database_units") * (F.col("documents") + DATABASE_BASE_MINUTES) / 60 * DATABASE_UNIT_HOUR + DATABASE_GIB / 30 * DATABASE_GIB_MONTH,
        "storage": F.when(F.col("bucket"), F.col("documents") * DOCUMENT_BYTES / 1024**3 * (BUCKET_MINUTES / 43_200) * BUCKET_GIB_MONTH),
    }
    rows = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(o).alias("operation"), _micro(dollars[o]).alias("estimated_micro_usd"), dollars[o].isNotNull().alias("used")) for p, names in OPERATIONS.items() for o in names])
    return runs.select("run_id", F.explode(rows).alias("row")).select("run_id", "row.*").filter("used").drop("used")


def commitments(runs: DataFrame) -> DataFrame:
    """What each run commits at most."""
    return infrastructure_costs(runs).groupBy("run_id").agg(F.sum("estimated_micro_usd").alias("committed_micro_usd"))
