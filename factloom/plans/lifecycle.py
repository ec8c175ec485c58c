"""Queries on runs, uploads, costs, merges and citations over the driver tables, each with equal SQL.

Orders stand for runs and grants, line items for documents, citations and receipts, events for costs; the columns that
these tables lack are made from their keys, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import citations, coverage, extract, ledgers, materialize, packages, pages, records, runs, uploads
from factloom.sources.staging import stage
from factloom.sources.tables import pages_of_documents, table

from .structural import CHUNKS_SQL, COSTS_SQL, SENTENCES_SQL, SHA, _chunks, _costs

NOW = "1996-06-01 00:00:00"
STATES = list(packages.PROGRESS)


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = lambda **d: F.col("o_orderdate") + F.make_dt_interval(**{n: v.cast("int") for n, v in d.items()})
    some = lambda n, value: F.when(k % n == 0, value)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 50).alias("owner_id"), F.element_at(F.array(*map(F.lit, STATES)), (k % len(STATES) + 1).cast("int")).alias("status"),
        F.col("o_orderdate").alias("updated_at"), at(days=k % 7).alias("expires_at"), some(3, at(days=k % 40)).alias("audit_expires_at"), some(2, at(hours=k % 5)).alias("lease_expires_at"),
        (k % 4).alias("fence"), some(5, F.col("o_orderdate")).alias("paid_started_at"), F.when(k % 11 == 0, 1).otherwise(0).alias("watchdogs"), some(6, at(mins=k % 9)).alias("admission_expires_at"),
        some(4, at(mins=k % 3)).alias("dispatch_claimed_at"), some(12, k.cast("string")).alias("workflow_id"), some(8, F.lit("dispatching")).alias("retry_status"), some(8, at(mins=k % 5)).alias("retry_claimed_at"),
        some(9, at(hours=k % 3)).alias("retry_uncertain_at"), (k % 3 != 1).alias("cleanup_confirmed"), F.when(k % 10 == 0, "expired").when(k % 10 == 1, "failed").alias("terminal"),
    )


RUNS_SQL = f"""runs AS (SELECT o_orderkey AS id, o_custkey % 50 AS owner_id, ({STATES!r})[CAST(o_orderkey % {len(STATES)} AS INTEGER) + 1] AS status, o_orderdate AS updated_at, o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS expires_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS audit_expires_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + to_hours(o_orderkey % 5) END AS lease_expires_at, o_orderkey % 4 AS fence,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS paid_started_at, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS watchdogs, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + to_minutes(o_orderkey % 9) END AS admission_expires_at,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_minutes(o_orderkey % 3) END AS dispatch_claimed_at, CASE WHEN o_orderkey % 12 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS workflow_id, CASE WHEN o_orderkey % 8 = 0 THEN 'dispatching' END AS retry_status,
  CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + to_minutes(o_orderkey % 5) END AS retry_claimed_at, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + to_hours(o_orderkey % 3) END AS retry_uncertain_at, o_orderkey % 3 <> 1 AS cleanup_confirmed,
  CASE WHEN o_orderkey % 10 = 0 THEN 'expired' WHEN o_orderkey % 10 = 1 THEN 'failed' END AS terminal, TIMESTAMP '{NOW}' AS now FROM orders)"""
LEASED_SQL = f"status IN {runs.LEASED!r}"


def q_status_view(spark, sf_dir):
    return runs.status_view(_runs(spark, sf_dir), _costs(spark, sf_dir))


Q_STATUS_VIEW = f"""WITH {RUNS_SQL}, {COSTS_SQL}, s AS (SELECT run_id, sum(coalesce(actual_micro_usd, estimated_micro_usd, 0)) AS cost, bool_or(status = 'pending') AS pending, bool_or(actual_micro_usd IS NULL) AS unpriced FROM costs GROUP BY run_id)
SELECT id, status, CAST(map({STATES!r}, {list(packages.PROGRESS.values())!r})[status] AS INTEGER) AS progress, updated_at, expires_at, cleanup_confirmed, CAST(coalesce(cost, 0) AS BIGINT) AS cost_micro_usd,
  CASE WHEN paid_started_at IS NULL THEN 'no_paid_attempt' WHEN pending THEN 'estimated_pending' WHEN unpriced THEN 'estimated_complete' ELSE 'actual_complete' END AS cost_accounting_status FROM runs LEFT JOIN s ON run_id = id"""


def q_publishable(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", runs.publishable(F.col("status"), F.col("cleanup_confirmed")).alias("publishable"), runs.terminal_status(F.when(F.col("id") % 3 == 0, "incomplete").otherwise("ready")).alias("terminal_status"))


Q_PUBLISHABLE = f"WITH {RUNS_SQL} SELECT id, cleanup_confirmed AND status IN ('ready', 'partial') AS publishable, CASE WHEN id % 3 = 0 THEN 'partial' ELSE 'ready' END AS terminal_status FROM runs"


def q_admission_claims(spark, sf_dir):
    return runs.claim_admission(_runs(spark, sf_dir), _now()).select("id", "admission_expires_at")


Q_ADMISSION = f"WITH {RUNS_SQL} SELECT id, now + to_minutes(2) AS admission_expires_at FROM runs WHERE status = 'queued' AND workflow_id IS NULL AND dispatch_claimed_at IS NULL AND (admission_expires_at IS NULL OR admission_expires_at <= now)"


def q_dispatch_claims(spark, sf_dir):
    held = _runs(spark, sf_dir)
    taken = runs.claim_dispatch(held, _now()).select("id", F.lit(True).alias("claimed"))
    settled = runs.settle_dispatch(F.col("retry_status"), F.when(F.col("id") % 16 == 0, "started").otherwise("uncertain"))
    return held.join(taken, "id", "left").select("id", F.coalesce("claimed", F.lit(False)).alias("claimed"), settled.alias("settled"))


Q_DISPATCH = f"WITH {RUNS_SQL} SELECT id, status = 'queued' AND dispatch_claimed_at IS NULL AND workflow_id IS NULL AND admission_expires_at IS NOT NULL AS claimed, CASE WHEN retry_status = 'dispatching' THEN CASE WHEN id % 16 = 0 THEN 'started' ELSE 'uncertain' END ELSE retry_status END AS settled FROM runs"


def q_processing_claims(spark, sf_dir):
    return runs.claim_processing(_runs(spark, sf_dir), _now()).select("id", "status", "fence", "lease_expires_at")


Q_PROCESSING = f"WITH {RUNS_SQL} SELECT id, 'validating' AS status, fence + 1 AS fence, now + to_seconds(45) AS lease_expires_at FROM runs WHERE paid_started_at IS NULL AND watchdogs = 0 AND (status = 'queued' OR ({LEASED_SQL} AND lease_expires_at <= now))"


def q_lease_expired_updates(spark, sf_dir):
    return runs.if_lease_expired(_runs(spark, sf_dir), _now(), status=F.lit("failed"), fence=F.col("fence") + 1).select("id", "applied", "status", "fence")


Q_LEASE_EXPIRED = f"WITH {RUNS_SQL}, a AS (SELECT *, ({LEASED_SQL} OR status = 'cleanup_pending') AND coalesce(lease_expires_at <= now, false) AS applied FROM runs) SELECT id, applied, CASE WHEN applied THEN 'failed' ELSE status END AS status, CASE WHEN applied THEN fence + 1 ELSE fence END AS fence FROM a"


def q_cleanup_retries(spark, sf_dir):
    return runs.claim_cleanup_retry(_runs(spark, sf_dir), _now()).select("id", "retry_claimed_at", "retry_status")


Q_RETRIES = f"WITH {RUNS_SQL} SELECT id, now AS retry_claimed_at, 'dispatching' AS retry_status FROM runs WHERE status = 'cleanup_pending' AND retry_claimed_at IS NULL"


def q_recovery_sweep(spark, sf_dir):
    return runs.recovery(runs.unscheduled(_runs(spark, sf_dir), _now(), 60), _now()).select("id", "outcome")


Q_RECOVERY = f"""WITH {RUNS_SQL}, q AS (SELECT * FROM runs WHERE status = 'queued' AND updated_at <= now ORDER BY updated_at, id LIMIT 60)
SELECT id, CASE WHEN expires_at <= now THEN 'expired' WHEN dispatch_claimed_at + to_seconds(60) > now THEN 'deferred' WHEN dispatch_claimed_at IS NOT NULL THEN 'failed' ELSE 'recovered' END AS outcome FROM q"""


def q_maintenance_summary(spark, sf_dir):
    """All queued runs of all times, each judged ninety seconds after it was last touched."""
    now = runs.later(F.col("updated_at"), 90)
    return runs.recovery(_runs(spark, sf_dir).filter("status = 'queued'"), now).groupBy("outcome").agg(F.count("*").alias("runs"))


Q_MAINTENANCE = f"""WITH {RUNS_SQL}, q AS (SELECT *, updated_at + to_seconds(90) AS t FROM runs WHERE status = 'queued')
SELECT CASE WHEN expires_at <= t THEN 'expired' WHEN dispatch_claimed_at + to_seconds(60) > t THEN 'deferred' WHEN dispatch_claimed_at IS NOT NULL THEN 'failed' ELSE 'recovered' END AS outcome, count(*) AS runs FROM q GROUP BY 1"""


def q_cleanup_candidates(spark, sf_dir):
    return runs.cleanup_candidates(_runs(spark, sf_dir), _now(), 500).select("id", F.array_join("reasons", ",").alias("reasons"))


Q_CANDIDATES = f"""WITH {RUNS_SQL}, d AS (SELECT id, updated_at, concat_ws(',', CASE WHEN status <> 'expired' AND expires_at <= now THEN 'expired' END, CASE WHEN status = 'expired' AND audit_expires_at <= now THEN 'audit_expired' END,
  CASE WHEN {LEASED_SQL} AND lease_expires_at <= now THEN 'lease_lapsed' END, CASE WHEN status = 'cleanup_pending' AND retry_uncertain_at <= now THEN 'retry_uncertain' END,
  CASE WHEN status = 'cleanup_pending' AND retry_status = 'dispatching' AND retry_claimed_at + to_seconds(60) <= now THEN 'retry_orphaned' END, CASE WHEN status = 'cleanup_pending' AND updated_at + to_seconds(300) <= now THEN 'stale' END) AS reasons FROM runs)
SELECT id, reasons FROM d WHERE reasons <> '' ORDER BY updated_at, id LIMIT 500"""


def q_expiry(spark, sf_dir):
    return runs.expire(_runs(spark, sf_dir), _now()).select("id", "status", "owner_id", "audit_expires_at")


Q_EXPIRY = f"""WITH {RUNS_SQL}, d AS (SELECT *, status <> 'expired' AND expires_at <= now AS due FROM runs WHERE NOT (status = 'expired' AND coalesce(audit_expires_at <= now, false)))
SELECT id, CASE WHEN due THEN 'expired' ELSE status END AS status, CASE WHEN due OR status = 'expired' THEN sha256(CAST(owner_id AS VARCHAR)) ELSE CAST(owner_id AS VARCHAR) END AS owner_id, CASE WHEN due THEN now + to_days(30) ELSE audit_expires_at END AS audit_expires_at FROM d"""


def q_owner_view(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 2).alias("owner_id"))
    return runs.owner_view(_runs(spark, sf_dir), asked, _now()).select("id", "owner_id", "status")


Q_OWNER = f"WITH {RUNS_SQL} SELECT id, owner_id, CASE WHEN status <> 'expired' AND expires_at <= now THEN 'expired' ELSE status END AS status FROM runs WHERE id % 2 = 0"


def q_cancelled_runs(spark, sf_dir):
    asked = F.when(F.col("id") % 7 == 0, "expired").otherwise("failed")
    return runs.cancel(_runs(spark, sf_dir), asked, _now()).select("id", "status", "terminal", "fence", "quiet")


Q_CANCEL = f"""WITH {RUNS_SQL}, c AS (SELECT id, cleanup_confirmed, fence + 1 AS fence, CASE WHEN id % 7 = 0 OR coalesce(terminal = 'expired', false) THEN 'expired' ELSE 'failed' END AS terminal, lease_expires_at IS NULL OR lease_expires_at <= now AS quiet FROM runs)
SELECT id, CASE WHEN quiet AND cleanup_confirmed THEN terminal ELSE 'cleanup_pending' END AS status, terminal, fence, quiet FROM c"""


def q_one_active_run(spark, sf_dir):
    return runs.one_active(_runs(spark, sf_dir)).select("id", "owner_id")


Q_ONE_ACTIVE = f"WITH {RUNS_SQL} SELECT id, owner_id FROM runs WHERE status IN {runs.ACTIVE!r} QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY updated_at, id) > 1"


def q_source_watchdogs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 12)
    some = lambda n: F.when(F.col("k") % n == 0, F.col("l_shipdate"))
    state = runs.watchdog_state(some(2), some(3), some(4), F.col("l_shipdate"), some(6), _now())
    return lines.select(state.alias("state"), runs.may_clean_source(some(3), some(4), F.col("l_shipdate"), _now()).alias("may_clean")).groupBy("state", "may_clean").agg(F.count("*").alias("sources"))


Q_WATCHDOGS = f"""WITH l AS (SELECT l_partkey % 12 AS k, l_shipdate <= TIMESTAMP '{NOW}' AS past FROM lineitem)
SELECT CASE WHEN k % 6 = 0 THEN 'confirmed' WHEN k % 4 = 0 THEN 'captured' WHEN k % 3 = 0 AND past THEN 'released' WHEN k % 3 = 0 THEN 'started' WHEN k % 2 = 0 THEN 'armed' ELSE 'none' END AS state, k % 3 <> 0 OR k % 4 = 0 OR past AS may_clean, count(*) AS sources FROM l GROUP BY ALL"""


def q_cleanup_disclosure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("resource_id"), F.when(F.col("l_linenumber") % 3 == 0, "provider").otherwise("application").alias("control_scope"), F.when(F.col("l_linestatus") == "F", "deleted").otherwise("unknown").alias("status"))
    return runs.disclosure(lines, "run_id")


Q_DISCLOSURE = """WITH r AS (SELECT l_orderkey AS run_id, l_partkey AS res, l_linenumber % 3 = 0 AS provider, l_linestatus = 'F' AS deleted FROM lineitem), m AS (SELECT run_id, res, bool_or(NOT provider) AS ours, bool_or(deleted) AS deleted, bool_or(provider AND NOT deleted) AS u FROM r GROUP BY ALL)
SELECT run_id, bool_and(NOT ours OR deleted) AS application_controlled_deleted, CASE WHEN bool_or(u) THEN 'unknown' ELSE 'not_applicable' END AS provider_retention FROM m GROUP BY run_id"""


def q_plan_fits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("documents"), F.sum(F.col("l_quantity").cast("long")).alias("reserved"))
    return lines.select("id", runs.plan_fits(F.col("documents"), F.lit(20), F.lit(15), F.col("reserved"), F.lit(200)).alias("fits"))


Q_PLAN = "SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT)) <= 200 AND count(*) * 20 + 15 <= sum(CAST(l_quantity AS BIGINT)) AS fits FROM lineitem GROUP BY 1"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.when(F.col("l_linenumber") == 1, "base").otherwise("amendment").alias("role"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.col("l_quantity") * 3).cast("long").alias("pages"))


def q_request_checks(spark, sf_dir):
    return packages.requests(_documents(spark, sf_dir))


Q_REQUESTS = """WITH d AS (SELECT l_orderkey AS package_id, count(*) AS documents, count(*) FILTER (l_linenumber = 1) AS bases, CAST(sum(CAST(l_quantity * 3 AS BIGINT)) AS BIGINT) AS pages FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN documents > 5 THEN 'too_many_documents' WHEN bases <> 1 THEN 'not_one_base' WHEN pages > 300 THEN 'too_many_pages' END AS reason FROM d"""


def q_page_allowance(spark, sf_dir):
    return runs.page_allowance(_documents(spark, sf_dir), "package_id", ("line", "part", "pages"), "pages").groupBy("within").agg(F.count("*").alias("documents"), F.sum("allowance").alias("allowance"))


Q_ALLOWANCE = """WITH d AS (SELECT CAST(l_quantity * 3 AS BIGINT) AS pages, greatest(0, 300 - coalesce(sum(CAST(l_quantity * 3 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS allowance FROM lineitem)
SELECT pages <= allowance AS within, count(*) AS documents, CAST(sum(allowance) AS BIGINT) AS allowance FROM d GROUP BY 1"""


def _grants(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda **d: F.col("o_orderdate") + F.make_dt_interval(**{n: v.cast("int") for n, v in d.items()})
    state = F.element_at(F.array(*map(F.lit, ("issued", "uploaded", "claimed", "fenced", "deleted"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("path"), (F.col("o_custkey") % 50).alias("owner_id"), F.sha2(k.cast("string"), 256).alias("sha256"), (k % 1000).alias("size_bytes"), state.alias("status"), F.when(k % 5 > 1, k * 2).alias("run_id"), at(days=k % 700).alias("expires_at"), at(days=k % 9).alias("cleanup_due_at"), at(days=k % 20).alias("hard_delete_by"), F.when(k % 3 == 0, at(days=k % 800)).alias("lease_expires_at"), (k % 4).alias("attempts"))


GRANTS_SQL = f"""grants AS (SELECT o_orderkey AS path, o_custkey % 50 AS owner_id, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, o_orderkey % 1000 AS size_bytes, (['issued', 'uploaded', 'claimed', 'fenced', 'deleted'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS status, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey * 2 END AS run_id,
  o_orderdate + to_days(CAST(o_orderkey % 700 AS INTEGER)) AS expires_at, o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS cleanup_due_at, o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS hard_delete_by, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 800 AS INTEGER)) END AS lease_expires_at, o_orderkey % 4 AS attempts, TIMESTAMP '{NOW}' AS now FROM orders)"""


def q_upload_quotas(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 50).alias("quota_key"), F.col("value").cast("long").alias("size_bytes"))
    asked = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 50).alias("quota_key"), (F.col("user_id") % 50).alias("owner_id"), (F.col("event_id") % 900).alias("size_bytes"))
    return uploads.permitted(asked, _grants(spark, sf_dir), events, _now(), 5, 3, 500, 20_000).groupBy("reason").agg(F.count("*").alias("requests"))


Q_UPLOAD_QUOTAS = f"""WITH {GRANTS_SQL}, o AS (SELECT owner_id, count(*) AS n FROM grants WHERE status IN ('issued', 'uploaded') AND expires_at > now GROUP BY 1), e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 50 AS k, CAST(trunc(value) AS BIGINT) AS b, event_id FROM events),
m AS (SELECT day, k, count(*) AS d, sum(b) AS b FROM e GROUP BY ALL), a AS (SELECT day, sum(b) AS b FROM e GROUP BY ALL)
SELECT CASE WHEN coalesce(o.n, 0) >= 5 THEN 'outstanding_grants' WHEN m.d >= 3 THEN 'documents_of_day' WHEN m.b + event_id % 900 > 500 THEN 'bytes_of_day' WHEN a.b + event_id % 900 > 20000 THEN 'bytes_of_all' END AS reason, count(*) AS requests
FROM e LEFT JOIN o ON o.owner_id = e.k JOIN m ON m.day = e.day AND m.k = e.k JOIN a ON a.day = e.day GROUP BY 1"""


def q_upload_claims(spark, sf_dir):
    grants = _grants(spark, sf_dir)
    asked = grants.select("path", "owner_id", F.when(F.col("path") % 9 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), "size_bytes", (F.col("path") * 2 + F.when(F.col("path") % 8 == 0, 1).otherwise(0)).alias("run_id"))
    return uploads.claims(asked, grants, _now()).select("path", "run_id", "outcome")


Q_UPLOAD_CLAIMS = f"""WITH {GRANTS_SQL}, r AS (SELECT *, path * 2 + CASE WHEN path % 8 = 0 THEN 1 ELSE 0 END AS mine, path % 9 <> 0 AS same FROM grants)
SELECT path, mine AS run_id, CASE WHEN same AND status IN ('issued', 'uploaded') AND expires_at > now THEN 'claimed' WHEN same AND status IN ('claimed', 'fenced') AND mine = run_id THEN 'replayed' ELSE 'refused' END AS outcome FROM r"""


def q_upload_sweep(spark, sf_dir):
    return uploads.sweep(_grants(spark, sf_dir), _now()).select("path", "lease_expires_at", "attempts", "overdue")


Q_UPLOAD_SWEEP = f"""WITH {GRANTS_SQL} SELECT path, now + to_seconds(60) AS lease_expires_at, attempts + 1 AS attempts, hard_delete_by <= now AS overdue FROM grants
WHERE cleanup_due_at <= now AND status <> 'deleted' AND (lease_expires_at IS NULL OR lease_expires_at <= now) ORDER BY cleanup_due_at, path LIMIT 100"""


def q_cost_merge(spark, sf_dir):
    costs = _costs(spark, sf_dir).select("event_id", "provider", "actual_micro_usd", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 300).alias("attempt_id"))
    return ledgers.merged_costs(costs.filter("event_id % 2 = 0"), costs.filter("event_id % 2 = 1 OR event_id % 7 = 0"), "attempt_id", "event_id")


Q_COST_MERGE = f"""WITH {COSTS_SQL}, c AS (SELECT event_id, provider, actual_micro_usd, CASE WHEN event_id % 7 <> 0 THEN event_id % 300 END AS attempt_id FROM costs)
SELECT * FROM c WHERE attempt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY event_id % 2 DESC, event_id DESC) = 1 UNION ALL SELECT * FROM c WHERE attempt_id IS NULL"""


def q_provider_costs(spark, sf_dir):
    settled = _costs(spark, sf_dir).filter("status != 'pending'").withColumn("latency_ms", F.col("event_id") % 1000)
    return ledgers.provider_costs(settled)


Q_PROVIDER_COSTS = f"""WITH {COSTS_SQL}, r AS (SELECT provider, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(actual_micro_usd), 0) AS BIGINT) AS actual_micro_usd,
  CAST(sum(CASE WHEN actual_micro_usd IS NULL THEN coalesce(estimated_micro_usd, 0) ELSE 0 END) AS BIGINT) AS estimated_micro_usd, bool_or(status = 'failed') AS any_failed, CAST(sum(event_id % 1000) AS BIGINT) AS latency_ms FROM costs WHERE status <> 'pending' GROUP BY provider)
SELECT *, actual_micro_usd + estimated_micro_usd AS total_micro_usd FROM r"""


def q_token_totals(spark, sf_dir):
    return ledgers.token_totals(table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 500).alias("tokens_in"), (F.col("n_chars") % 70).alias("tokens_out"), F.octet_length("text").cast("long").alias("bytes")), "source")


Q_TOKEN_TOTALS = """WITH s AS (SELECT source, CAST(sum(n_chars % 500) AS BIGINT) AS tokens_in, CAST(sum(n_chars % 70) AS BIGINT) AS tokens_out, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS calls FROM documents GROUP BY 1)
SELECT *, CAST(ceil(tokens_in * CAST(0.75 AS DOUBLE) + tokens_out * CAST(4.5 AS DOUBLE)) AS BIGINT) + calls - 1 AS most_micro_usd FROM s"""


def _receipts(spark, sf_dir, part):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") % 2 == part).select(F.concat_ws("-", "l_orderkey", F.col("l_partkey") % 3).alias("receipt_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("state"))


def q_receipt_merge(spark, sf_dir):
    old = citations.first_of_each(_receipts(spark, sf_dir, 0), ("receipt_id",), ("state",))
    return records.upsert(old, _receipts(spark, sf_dir, 1), "receipt_id", "state")


Q_RECEIPTS = """WITH r AS (SELECT l_orderkey || '-' || l_partkey % 3 AS receipt_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR)) AS state, l_linenumber % 2 AS part FROM lineitem)
SELECT receipt_id, CASE WHEN bool_or(part = 1) THEN max(state) FILTER (part = 1) ELSE min(state) END AS state FROM r GROUP BY 1"""


def q_cascading_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    kept, children = records.without(orders, orders.filter("o_orderkey % 3 = 0"), "o_orderkey", (lines, "l_orderkey"))
    return children.groupBy("l_linenumber").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("orders_left"))))


Q_CASCADE = "SELECT l_linenumber, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS orders_left FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1"


def q_bounded_merge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return records.bounded_union(lines, lines, ("l_orderkey",), 1000).groupBy("l_orderkey").agg(F.count("*").alias("parts"))


Q_BOUNDED = "SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"


def q_recovered_first(spark, sf_dir):
    drafts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 150).alias("key"), "lang")
    found = drafts.filter("id % 11 = 0").withColumn("id", F.col("id") + 1)
    return records.recovered_first(drafts, found, ("key", "lang"), "id").groupBy("recovered", "lang").agg(F.count("*").alias("records"), F.sum("id").alias("ids"))


Q_RECOVERED = """WITH d AS (SELECT doc_id AS id, doc_id % 150 AS key, lang FROM documents), f AS (SELECT id + 1 AS id, key, lang FROM d WHERE id % 11 = 0)
SELECT recovered, lang, count(*) AS records, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT true AS recovered, lang, id FROM f UNION ALL SELECT false, lang, id FROM d WHERE (key, lang) NOT IN (SELECT key, lang FROM f) AND id NOT IN (SELECT id FROM f)) GROUP BY ALL"""


def q_same_manifests(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return records.same_multisets(lines, lines.filter("l_orderkey % 4 != 0 OR l_suppkey % 2 = 0"), "l_orderkey", "l_suppkey")


Q_MANIFESTS = "WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, bool_and(n = 1 AND (l_orderkey % 4 <> 0 OR l_suppkey % 2 = 0)) AS same FROM c GROUP BY 1"


def q_ordered_union(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).cast("string").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return records.ordered_union(lines, "l_orderkey", "id", "at").select("l_orderkey", F.array_join("items", ",").alias("ids"))


Q_ORDERED = """WITH f AS (SELECT l_orderkey, CAST(l_suppkey % 5 AS VARCHAR) AS id, min((l_linenumber, l_partkey, l_suppkey)) AS place FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(id, ',' ORDER BY place, id) AS ids FROM f GROUP BY 1"""


def q_annotation_match(spark, sf_dir):
    """Documents against labels and turns as annotations."""
    marks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 3).alias("doc_id"))
    return records.matched(table(spark, sf_dir, "documents").select("doc_id"), marks, ("doc_id",)).groupBy("match").agg(F.count("*").alias("records"), F.sum("n_annotations").alias("annotations"))


Q_ANNOTATIONS = """WITH a AS (SELECT conv_id * 3 AS doc_id, count(*) AS n FROM conversations GROUP BY 1), m AS (SELECT coalesce(n, 0) AS n FROM documents LEFT JOIN a USING (doc_id))
SELECT CASE WHEN n = 1 THEN 'one' WHEN n = 0 THEN 'missing' ELSE 'duplicate' END AS match, count(*) AS records, CAST(sum(n) AS BIGINT) AS annotations FROM m GROUP BY 1"""


def q_coverage_header(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag")
    return records.coverage_header(lines, lines.filter("l_linestatus = 'F'"), lines.filter("l_returnflag = 'R'"), "l_orderkey", "l_partkey")


Q_HEADER = """WITH h AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS expected, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS verified, count(*) FILTER (l_returnflag = 'R') AS unresolved FROM lineitem GROUP BY 1)
SELECT *, expected = verified AND unresolved = 0 AS complete FROM h"""


def q_worst_binding(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 2 == 0).alias("semantic"))
    ranks = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return records.worst(orders, "o_custkey", "o_orderpriority", ranks, "semantic")


Q_WORST = "SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, bool_or(o_orderkey % 2 = 0) AS any_semantic, bool_and(o_orderkey % 2 = 0) AS all_semantic FROM orders GROUP BY 1"


def q_chosen_batch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4 == 0).alias("contains"), F.col("l_extendedprice").alias("bytes"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("batch"))
    return records.chosen_batch(lines, "l_orderkey")


Q_CHOSEN = """SELECT l_orderkey, l_partkey % 4 = 0 AS contains, l_extendedprice AS bytes, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS batch FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 4 = 0 DESC, l_extendedprice, concat_ws('-', l_linenumber, l_partkey, l_suppkey)) = 1"""


def q_most_complete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sequence(F.lit(0), (F.col("n_chars") % 9).cast("int")).alias("tokens"))
    return records.most_complete(docs, "source", "tokens", "doc_id").select("source", "doc_id")


Q_MOST_COMPLETE = "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars % 9 DESC, doc_id) = 1"


def q_json_bytes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", records.json_bytes("n_name", "n_nationkey").alias("bytes"))


Q_JSON = """SELECT n_nationkey, strlen('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS bytes FROM nation"""


def q_populated_values(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("kind"), "event_id")
    at = F.col("event_id")
    return events.groupBy("user_id").agg(records.first_populated("kind", at).alias("first_kind"), records.last_populated("kind", at).alias("last_kind"), records.longest("kind", at).alias("longest_kind"))


Q_POPULATED = """WITH e AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END AS kind FROM events)
SELECT user_id, arg_min(kind, event_id) FILTER (kind <> '') AS first_kind, arg_max(kind, event_id) FILTER (kind <> '') AS last_kind, arg_max(kind, length(kind) * 1000000000 - event_id) FILTER (kind IS NOT NULL) AS longest_kind FROM e GROUP BY 1"""


def q_requirement_counts(spark, sf_dir):
    """Orders as requirements: counts by status per owner, and of financial ones."""
    orders = table(spark, sf_dir, "orders").withColumn("financial", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return orders.groupBy("o_custkey").agg(F.count("*").alias("requirements"), *[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "open"), ("F", "met"), ("P", "partly"))], F.count_if("financial").alias("financial"))


Q_REQUIREMENTS = "SELECT o_custkey, count(*) AS requirements, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS met, count(*) FILTER (o_orderstatus = 'P') AS partly, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS financial FROM orders GROUP BY 1"


def q_summary_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return materialize.summary_value(orders.select(F.col("o_custkey").alias("package_id"), F.col("o_orderstatus").alias("field"), F.when(F.col("o_custkey") % 2 == 0, "3-MEDIUM").alias("preferred"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("source_value")))


Q_SUMMARY = """WITH g AS (SELECT o_custkey AS package_id, o_orderstatus AS field, list(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 <> 0) AS v FROM orders GROUP BY ALL)
SELECT package_id, field, CASE WHEN package_id % 2 = 0 AND list_contains(v, '3-MEDIUM') THEN '3-MEDIUM' WHEN len(v) = 1 THEN v[1] END AS value FROM g"""


def q_citation_offsets(spark, sf_dir):
    docs = pages_of_documents(table(spark, sf_dir, "documents"))
    start = F.length("text") % 97
    asked = docs.select("document_sha256", "page", start.alias("start"), (start + 40).alias("end"), F.substring("text", start + 1 + F.length("text") % 2, F.lit(40)).alias("evidence_quote"))
    return citations.verify_at_offsets(asked, docs).select("document_sha256", "verified")


Q_OFFSETS = f"WITH d AS (SELECT {SHA} AS document_sha256, coalesce(text, '') AS t FROM documents) SELECT document_sha256, substring(t, CAST(length(t) % 97 + 1 AS BIGINT), 40) = substring(t, CAST(length(t) % 97 + 1 + length(t) % 2 AS BIGINT), 40) AS verified FROM d"


def q_citation_in_chunk(spark, sf_dir):
    """The first sentence of each document, with the chunk that it comes from: looked for on the page that alone has the chunk."""
    chunks = stage(_chunks(spark, sf_dir), "chunks")
    claims = extract.scope_claims(chunks).select("document_sha256", F.col("document_sha256").alias("candidate_id"), F.col("quote").alias("evidence_quote"), "ordinal")
    asked = stage(claims.join(chunks.select("document_sha256", "ordinal", "chunk_id"), ["document_sha256", "ordinal"]), "asked")
    pages_ = chunks.select("document_sha256", F.col("ordinal").alias("page"), "text")
    within = stage(citations.restricted_to_chunks(asked, chunks, pages_), "within")
    return citations.verify_citations(within, pages_, repair=False, compose=False).select("candidate_id", "page", "method", "verified")


Q_IN_CHUNK = f"""
WITH {CHUNKS_SQL}, s AS (SELECT document_sha256, ordinal, text AS body, {SENTENCES_SQL}[1] AS q FROM chunks), first AS (SELECT document_sha256, arg_min(q, ordinal) AS quote, arg_min(body, ordinal) AS body FROM s WHERE q IS NOT NULL GROUP BY 1
), p AS (SELECT *, contains(c.text, f.body) AS has, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) AS plain FROM first f JOIN chunks c USING (document_sha256)
), w AS (SELECT *, count(*) FILTER (has) OVER (PARTITION BY document_sha256) AS n FROM p
), r AS (SELECT document_sha256, count(*) FILTER (contains(text, quote)) AS ne, min(ordinal) FILTER (contains(text, quote)) AS pe, count(*) FILTER (contains(plain, lower(quote))) AS np, min(ordinal) FILTER (contains(plain, lower(quote))) AS pp FROM w WHERE n <> 1 OR has GROUP BY 1)
SELECT document_sha256 AS candidate_id, CASE WHEN ne = 1 THEN pe WHEN np = 1 THEN pp END AS page, CASE WHEN ne = 1 THEN 'exact' WHEN np = 1 THEN 'normalized' ELSE 'manual_required' END AS method, ne = 1 OR np = 1 AS verified FROM r"""


def q_text_overlap(spark, sf_dir):
    """Benchmark passages against each document's first words, by language of no meaning: either contains the other, or digests agree."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("k"), "item_id", F.when(F.col("item_id") % 4 != 0, F.substring("text", 1, 60)).alias("text"), F.sha2(F.substring("text", 1, 60), 256).alias("sha256"))
    others = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("k"), F.col("item_id").alias("other_id"), F.substring("text", 11, 30).alias("relation_text"), F.sha2(F.substring("text", 1, 60), 256).alias("relation_sha256"))
    return citations.overlapping_texts(items, others, ("k",)).select("item_id", "other_id")


Q_TEXT_OVERLAP = """WITH b AS (SELECT item_id, substring(text, 1, 60) AS t, substring(text, 11, 30) AS r FROM benchmark)
SELECT a.item_id, o.item_id AS other_id FROM b a JOIN b o ON a.item_id % 5 = o.item_id % 5 AND CASE WHEN a.item_id % 4 <> 0 THEN contains(a.t, o.r) OR contains(o.r, a.t) ELSE a.t = o.t END"""


def q_tainted_batches(spark, sf_dir):
    """Documents by source as batches."""
    return coverage.tainted_batches(table(spark, sf_dir, "documents"), "source")


Q_TAINTED = f"SELECT source, count(*) AS texts, count(*) FILTER (regexp_matches(text, '{coverage.INJECTION}', 'is')) AS injected, count(*) FILTER (regexp_matches(text, '{coverage.INJECTION}', 'is')) > 0 AS tainted FROM documents GROUP BY 1"


def q_relation_offsets(spark, sf_dir):
    """Line items as relations: some empty, some beyond what is exact, half of them with a condition."""
    n = F.col("l_partkey")
    base = F.when(n % 11 == 0, F.lit(coverage.LARGEST)).otherwise(n)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", coverage.absolute_offsets(base, F.col("l_suppkey"), n % 7, F.when(n % 2 == 0, n % 5), F.when(n % 2 == 0, n % 3)).alias("at"))
    return lines.select("l_orderkey", "l_linenumber", F.col("at").isNotNull().alias("valid"), "at.*")


Q_OFFSETS_OF_RELATIONS = f"""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN {coverage.LARGEST} ELSE l_partkey END + l_suppkey AS b, l_partkey % 7 AS n, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 5 END AS c, l_partkey % 3 AS m FROM lineitem),
v AS (SELECT *, n > 0 AND b + n <= {coverage.LARGEST} AND (c IS NULL OR b + c + m <= {coverage.LARGEST}) AS valid FROM l)
SELECT l_orderkey, l_linenumber, valid, CASE WHEN valid THEN b END AS start, CASE WHEN valid THEN b + n END AS "end", CASE WHEN valid THEN b + c END AS condition_start, CASE WHEN valid THEN b + c + m END AS condition_end FROM v"""


def q_joined_pages(spark, sf_dir):
    return pages.joined(_chunks(spark, sf_dir), "document_sha256", "ordinal").select("document_sha256", F.sha2("text", 256).alias("text_sha256"))


Q_JOINED = f"WITH {CHUNKS_SQL} SELECT document_sha256, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM chunks GROUP BY 1"


def q_attempt_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ledgers.attempt_id(F.lit("extraction"), F.col("l_orderkey"), F.col("l_linenumber")).alias("attempt_id"))


Q_ATTEMPTS = """WITH d AS (SELECT l_orderkey, l_linenumber, sha256('extraction:' || l_orderkey || ':' || l_linenumber) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[strpos('0123456789abcdef', h[17]) % 4 + CASE WHEN strpos('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] AS attempt_id FROM d"""


SQL = {
    "q_status_view": Q_STATUS_VIEW, "q_publishable": Q_PUBLISHABLE, "q_admission_claims": Q_ADMISSION, "q_dispatch_claims": Q_DISPATCH, "q_processing_claims": Q_PROCESSING, "q_lease_expired_updates": Q_LEASE_EXPIRED, "q_cleanup_retries": Q_RETRIES,
    "q_recovery_sweep": Q_RECOVERY, "q_maintenance_summary": Q_MAINTENANCE, "q_cleanup_candidates": Q_CANDIDATES, "q_expiry": Q_EXPIRY, "q_owner_view": Q_OWNER, "q_cancelled_runs": Q_CANCEL, "q_one_active_run": Q_ONE_ACTIVE, "q_source_watchdogs": Q_WATCHDOGS,
    "q_cleanup_disclosure": Q_DISCLOSURE, "q_plan_fits": Q_PLAN, "q_request_checks": Q_REQUESTS, "q_page_allowance": Q_ALLOWANCE, "q_upload_quotas": Q_UPLOAD_QUOTAS, "q_upload_claims": Q_UPLOAD_CLAIMS, "q_upload_sweep": Q_UPLOAD_SWEEP, "q_cost_merge": Q_COST_MERGE,
    "q_provider_costs": Q_PROVIDER_COSTS, "q_token_totals": Q_TOKEN_TOTALS, "q_receipt_merge": Q_RECEIPTS, "q_cascading_delete": Q_CASCADE, "q_bounded_merge": Q_BOUNDED, "q_recovered_first": Q_RECOVERED, "q_same_manifests": Q_MANIFESTS, "q_ordered_union": Q_ORDERED,
    "q_annotation_match": Q_ANNOTATIONS, "q_coverage_header": Q_HEADER, "q_worst_binding": Q_WORST, "q_chosen_batch": Q_CHOSEN, "q_most_complete": Q_MOST_COMPLETE, "q_json_bytes": Q_JSON, "q_populated_values": Q_POPULATED, "q_requirement_counts": Q_REQUIREMENTS,
    "q_summary_values": Q_SUMMARY, "q_citation_offsets": Q_OFFSETS, "q_citation_in_chunk": Q_IN_CHUNK, "q_text_overlap": Q_TEXT_OVERLAP, "q_tainted_batches": Q_TAINTED, "q_relation_offsets": Q_OFFSETS_OF_RELATIONS, "q_joined_pages": Q_JOINED, "q_attempt_ids": Q_ATTEMPTS,
}
QUERIES = {name: globals()[name] for name in SQL}
