"""Upload grants: quotas, claims and the sweep of those past their time.

Grants have path, owner_id, sha256, size_bytes, status, run_id, expires_at, cleanup_due_at, hard_delete_by,
lease_expires_at and attempts; quota events have quota_key, owner_id, day and size_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import later, past

# The states in which a grant is outstanding, and in which it still has something to delete.
OUTSTANDING = ("issued", "uploaded")
HELD = ("issued", "uploaded", "claimed", "fenced")
CLEANUP_LEASE = 60


def permitted(requests: DataFrame, grants: DataFrame, events: DataFrame, now: Column, outstanding: int, documents: int, bytes_: int, bytes_of_all: int) -> DataFrame:
    """Requests (owner_id, quota_key, day, size_bytes) with the first quota that they would exceed as ``reason``, or null.

    Each is judged on what the ledgers hold, as a guarded insert is.
    """
    open_ = grants.filter(F.col("status").isin(*OUTSTANDING) & ~past(F.col("expires_at"), now)).groupBy("owner_id").agg(F.count("*").alias("_open"))
    mine = events.groupBy("quota_key", "day").agg(F.count("*").alias("_documents"), F.sum("size_bytes").alias("_bytes"))
    all_ = mine.groupBy("day").agg(F.sum("_bytes").alias("_all"))
    joined = requests.join(open_, "owner_id", "left").join(mine, ["quota_key", "day"], "left").join(F.broadcast(all_), "day", "left")
    sum_ = lambda c: F.coalesce(c, F.lit(0))
    reason = (
        F.when(sum_(F.col("_open")) >= outstanding, "outstanding_grants")
        .when(sum_(F.col("_documents")) >= documents, "documents_of_day")
        .when(sum_(F.col("_bytes")) + F.col("size_bytes") > bytes_, "bytes_of_day")
        .when(sum_(F.col("_all")) + F.col("size_bytes") > bytes_of_all, "bytes_of_all")
    )
    return joined.withColumn("reason", reason).drop("_open", "_documents", "_bytes", "_all")


def claims(requests: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """Requests (path, owner_id, sha256, size_bytes, run_id) with ``outcome``: claimed, replayed by the same run, or refused."""
    held = grants.select("path", *[F.col(c).alias("_" + c) for c in ("owner_id", "sha256", "size_bytes", "status", "run_id", "expires_at")])
    same = (F.col("owner_id") == F.col("_owner_id")) & (F.col("sha256") == F.col("_sha256")) & (F.col("size_bytes") == F.col("_size_bytes"))
    free = F.col("_status").isin(*OUTSTANDING) & ~past(F.col("_expires_at"), now)
    # Of several requests for a free grant the run that sorts first gets it.
    first = F.min(F.when(same & free, F.col("run_id"))).over(Window.partitionBy("path"))
    mine = F.coalesce(F.when(free, first), F.when(F.col("_status").isin("claimed", "fenced"), F.col("_run_id")))
    joined = requests.join(held, "path", "left")
    outcome = F.when(same & free & (F.col("run_id") == mine), "claimed").when(same & (F.col("run_id") == mine), "replayed").otherwise("refused")
    return joined.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def sweep(grants: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The grants to clean up, ``limit`` at most, with their new lease, one attempt more and whether they are overdue."""
    free = F.col("lease_expires_at").isNull() | past(F.col("lease_expires_at"), now)
    due = grants.filter(past(F.col("cleanup_due_at"), now) & F.col("status").isin(*HELD) & free)
    taken = due.orderBy("cleanup_due_at", "path").limit(max(1, min(limit, 100)))
    return taken.withColumns({"lease_expires_at": later(now, CLEANUP_LEASE), "attempts": F.col("attempts") + 1, "overdue": past(F.col("hard_delete_by"), now)})
