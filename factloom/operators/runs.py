"""The life of runs: what a caller sees of them, claims and their leases, sweeps, expiry and retention.

Runs have id, owner_id, status, updated_at, expires_at, audit_expires_at, lease_expires_at (of processing), fence,
paid_started_at, watchdogs (their number), admission_expires_at, dispatch_claimed_at, workflow_id, retry_status,
retry_claimed_at, retry_uncertain_at and cleanup_confirmed; each function reads some of them. ``now`` is a column, so
that a batch of events can carry its own times. A claim here is the new state of the rows that it may take; writing it
back against a concurrent writer is the table format's part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packages import PROGRESS

# The states in which a worker holds a lease, and the times of the life cycle in seconds.
LEASED = ("validating", "staging", "page_indexing", "parsing", "purging_source", "extracting", "reconciling", "verifying")
ACTIVE = ("queued", *LEASED, "cleanup_pending")
ADMISSION_LEASE, PROCESSING_LEASE, DISPATCH_GRACE, RETRY_GRACE, CLEANUP_CADENCE, AUDIT_RETENTION = 120, 45, 60, 60, 300, 30 * 24 * 3600
MOST_PAGES = 300


def later(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds))


def past(ts: Column, now: Column) -> Column:
    """Whether a time has come; no time never has."""
    return F.coalesce(ts <= now, F.lit(False))


def cost_status(paid_started: Column, pending: Column, unpriced: Column) -> Column:
    """What a run's cost figure stands for; ``pending`` and ``unpriced`` say whether any of its events is that."""
    return F.when(paid_started.isNull(), "no_paid_attempt").when(pending, "estimated_pending").when(unpriced, "estimated_complete").otherwise("actual_complete")


def status_view(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """What a caller sees of each run: state, progress, times, cost so far and what that figure stands for. ``costs`` has run_id, status, actual_micro_usd and estimated_micro_usd."""
    progress = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    sums = costs.groupBy(F.col("run_id").alias("id")).agg(
        F.sum(F.coalesce("actual_micro_usd", "estimated_micro_usd", F.lit(0))).alias("cost"),
        F.bool_or(F.col("status") == "pending").alias("pending"),
        F.bool_or(F.col("actual_micro_usd").isNull()).alias("unpriced"),
    )
    any_ = lambda c: F.coalesce(c, F.lit(False))
    seen = runs.join(sums, "id", "left")
    return seen.select("id", "status", progress[F.col("status")].alias("progress"), "updated_at", "expires_at", "cleanup_confirmed", F.coalesce("cost", F.lit(0)).alias("cost_micro_usd"), cost_status(F.col("paid_started_at"), any_(F.col("pending")), any_(F.col("unpriced"))).alias("cost_accounting_status"))


def publishable(status: Column, cleanup_confirmed: Column) -> Column:
    """A result is given out once cleanup is confirmed and the run is ready or partial."""
    return F.coalesce(cleanup_confirmed & status.isin("ready", "partial"), F.lit(False))


def terminal_status(readiness: Column) -> Column:
    return F.when(readiness == "incomplete", "partial").otherwise("ready")


def plan_fits(documents: Column, per_document: Column, rest: Column, reserved: Column, cap: Column) -> Column:
    """A paid plan may start if there is a document, the reservation is within the cap and all commitments are within the reservation."""
    return F.coalesce((documents >= 1) & (reserved <= cap) & (documents * per_document + rest <= reserved), F.lit(False))


def page_allowance(documents: DataFrame, package: str, order: tuple[str, ...], pages: str, most: int = MOST_PAGES) -> DataFrame:
    """Adds ``allowance``, the pages that each document may have after those before it, and ``within``."""
    before = F.coalesce(F.sum(pages).over(Window.partitionBy(package).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return documents.withColumn("allowance", F.greatest(F.lit(0), F.lit(most) - before)).withColumn("within", F.col(pages) <= F.col("allowance"))


def claim_admission(runs: DataFrame, now: Column, lease: int = ADMISSION_LEASE) -> DataFrame:
    """Queued runs that nobody dispatches and nobody else holds, with their new lease."""
    free = F.col("admission_expires_at").isNull() | past(F.col("admission_expires_at"), now)
    taken = runs.filter((F.col("status") == "queued") & F.col("workflow_id").isNull() & F.col("dispatch_claimed_at").isNull() & free)
    return taken.withColumn("admission_expires_at", later(now, lease))


def claim_dispatch(runs: DataFrame, now: Column) -> DataFrame:
    """Queued runs under an admission lease that were never dispatched; the claim is made once and for all."""
    free = F.col("dispatch_claimed_at").isNull() & F.col("workflow_id").isNull() & F.col("admission_expires_at").isNotNull()
    return runs.filter((F.col("status") == "queued") & free).withColumn("dispatch_claimed_at", now)


def claim_processing(runs: DataFrame, now: Column, lease: int = PROCESSING_LEASE) -> DataFrame:
    """Runs that a worker may take: queued, or left with a lapsed lease; none with a paid attempt or a watchdog. The fence goes up by one."""
    lapsed = F.col("status").isin(*LEASED) & past(F.col("lease_expires_at"), now)
    open_ = F.col("paid_started_at").isNull() & (F.col("watchdogs") == 0) & ((F.col("status") == "queued") | lapsed)
    return runs.filter(open_).withColumns({"status": F.lit("validating"), "lease_expires_at": later(now, lease), "fence": F.col("fence") + 1})


def if_lease_expired(runs: DataFrame, now: Column, **changes: Column) -> DataFrame:
    """Applies the changes to runs with a lapsed lease; ``applied`` says to which."""
    due = F.col("status").isin(*LEASED, "cleanup_pending") & past(F.col("lease_expires_at"), now)
    marked = runs.withColumn("applied", due)
    return marked.withColumns({name: F.when(F.col("applied"), value).otherwise(F.col(name)) for name, value in changes.items()})


def claim_cleanup_retry(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that wait for cleanup and have no retry yet."""
    free = (F.col("status") == "cleanup_pending") & F.col("retry_claimed_at").isNull()
    return runs.filter(free).withColumns({"retry_claimed_at": now, "retry_status": F.lit("dispatching")})


def settle_dispatch(status: Column, outcome: Column) -> Column:
    """The state of a dispatch after its outcome; only one that is under way is settled."""
    return F.when(status == "dispatching", outcome).otherwise(status)


def scan(runs: DataFrame, limit: int, most: int) -> DataFrame:
    """The runs that have waited longest, ``limit`` of them within 1 and ``most``."""
    return runs.orderBy("updated_at", "id").limit(min(max(limit, 1), most))


def unscheduled(runs: DataFrame, before: Column, limit: int = 20) -> DataFrame:
    return scan(runs.filter((F.col("status") == "queued") & past(F.col("updated_at"), before)), limit, 100)


def recovery(queued: DataFrame, now: Column) -> DataFrame:
    """Adds ``outcome`` to queued runs of a sweep: expired, deferred while a dispatch may still be under way, failed after that, else admitted anew."""
    fenced = F.col("dispatch_claimed_at").isNotNull()
    outcome = F.when(past(F.col("expires_at"), now), "expired").when(fenced & ~past(later(F.col("dispatch_claimed_at"), DISPATCH_GRACE), now), "deferred").when(fenced, "failed").otherwise("recovered")
    return queued.withColumn("outcome", outcome)


def cleanup_reasons(now: Column) -> Column:
    """Why a run is due for cleanup, all that apply."""
    status, waits = F.col("status"), F.col("status") == "cleanup_pending"
    tests = {
        "expired": (status != "expired") & past(F.col("expires_at"), now),
        "audit_expired": (status == "expired") & past(F.col("audit_expires_at"), now),
        "lease_lapsed": status.isin(*LEASED) & past(F.col("lease_expires_at"), now),
        "retry_uncertain": waits & past(F.col("retry_uncertain_at"), now),
        "retry_orphaned": waits & (F.col("retry_status") == "dispatching") & past(later(F.col("retry_claimed_at"), RETRY_GRACE), now),
        "stale": waits & past(later(F.col("updated_at"), CLEANUP_CADENCE), now),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def cleanup_candidates(runs: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    return scan(runs.withColumn("reasons", cleanup_reasons(now)).filter(F.size("reasons") > 0), limit, 1000)


def expire(runs: DataFrame, now: Column) -> DataFrame:
    """Runs past their time become expired, keep a digest of their owner only, and stay for the audit; those past that are gone."""
    gone = (F.col("status") == "expired") & past(F.col("audit_expires_at"), now)
    due = (F.col("status") != "expired") & past(F.col("expires_at"), now)
    kept = runs.filter(~gone).withColumn("_due", due)
    when = lambda value, old: F.when(F.col("_due"), value).otherwise(F.col(old))
    owner = F.sha2(F.col("owner_id").cast("string"), 256)
    return kept.withColumns({"audit_expires_at": when(later(now, AUDIT_RETENTION), "audit_expires_at"), "owner_id": F.when(F.col("_due") | (F.col("status") == "expired"), owner).otherwise(F.col("owner_id").cast("string")), "status": when(F.lit("expired"), "status")}).drop("_due")


def owner_view(runs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """What each request (owner_id, id) sees: the owner's run, as expired if its time is past; nothing of others' runs."""
    due = (F.col("status") != "expired") & past(F.col("expires_at"), now)
    return requests.join(runs, ["owner_id", "id"]).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def cancel(runs: DataFrame, requested: Column, now: Column) -> DataFrame:
    """Cancelled runs: the lease is revoked by a higher fence, expired wins over failed, and the end waits until the old lease has lapsed."""
    wins = F.when((requested == "expired") | (F.col("terminal") == "expired"), "expired").otherwise("failed")
    quiet = F.col("lease_expires_at").isNull() | past(F.col("lease_expires_at"), now)
    stopped = runs.withColumns({"terminal": wins, "fence": F.col("fence") + 1, "quiet": quiet})
    return stopped.withColumn("status", F.when(F.col("quiet") & F.col("cleanup_confirmed"), F.col("terminal")).otherwise("cleanup_pending"))


def one_active(runs: DataFrame) -> DataFrame:
    """Of each owner's active runs, all but the first: what an owner may not have started."""
    order = Window.partitionBy("owner_id").orderBy("updated_at", "id")
    return runs.filter(F.col("status").isin(*ACTIVE)).withColumn("_n", F.row_number().over(order)).filter("_n > 1").drop("_n")


def watchdog_state(armed: Column, started: Column, captured: Column, access_expires: Column, confirmed: Column, now: Column) -> Column:
    """How far the watchdog of a source is: confirmed, captured, released once access has run out, started, armed or none."""
    return F.when(confirmed.isNotNull(), "confirmed").when(captured.isNotNull(), "captured").when(started.isNotNull() & past(access_expires, now), "released").when(started.isNotNull(), "started").when(armed.isNotNull(), "armed").otherwise("none")


def may_clean_source(started: Column, captured: Column, access_expires: Column, now: Column) -> Column:
    """A source may be deleted unless a provider was called for it, has not delivered, and may still read it."""
    return started.isNull() | captured.isNotNull() | past(access_expires, now)


def disclosure(receipts: DataFrame, run: str) -> DataFrame:
    """Per run: whether every resource under our control has a receipt of deletion, and whether a provider's retention is unknown."""
    ours = F.col("control_scope") == "application"
    mine = receipts.groupBy(run, "resource_id").agg(F.bool_or(ours).alias("ours"), F.bool_or(F.col("status") == "deleted").alias("deleted"), F.bool_or(~ours & (F.col("status") == "unknown")).alias("unknown"))
    summed = mine.groupBy(run).agg(F.bool_and(~F.col("ours") | F.col("deleted")).alias("application_controlled_deleted"), F.bool_or("unknown").alias("_unknown"))
    return summed.select(run, "application_controlled_deleted", F.when(F.col("_unknown"), "unknown").otherwise("not_applicable").alias("provider_retention"))
