"""Queries over the driver tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import tokens as K
from factloom.operators import answers, citations, extract, facts, ledgers, packages, pages, records
from factloom.sources.tables import pages_of_documents, table

SHA = "sha256(CAST(doc_id AS VARCHAR))"
#: Chunking in SQL: paragraphs, windows of 3000 at a stride of 2800, trimmed.
CHUNKS_SQL = f"""
paras AS (
  SELECT {SHA} AS document_sha256, coalesce(text, '') AS text, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{{2,}}'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS ps
  FROM documents
), para AS (
  SELECT document_sha256, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [text] END) AS body, unnest(range(CASE WHEN len(ps) > 0 THEN len(ps) ELSE 1 END)) AS paragraph FROM paras
), cut AS (
  SELECT document_sha256, paragraph, body, unnest(range(0, greatest(length(body), 1), {pages.STRIDE})) AS off FROM para
), win AS (
  SELECT document_sha256, paragraph, off, trim(substring(body, off + 1, {pages.WIDTH}), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM cut
), chunks AS (
  SELECT document_sha256, CAST(row_number() OVER (PARTITION BY document_sha256 ORDER BY paragraph, off) - 1 AS INTEGER) AS ordinal, text FROM win WHERE text <> ''
)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunks(pages_of_documents(table(spark, sf_dir, "documents")))


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("document_sha256", "ordinal", "chunk_id", F.length("text").alias("chars"))


Q_CHUNKS = f"WITH {CHUNKS_SQL} SELECT document_sha256, ordinal, left(sha256(document_sha256 || chr(0) || CAST(ordinal AS VARCHAR) || chr(0) || text), 24) AS chunk_id, length(text) AS chars FROM chunks"


def q_cores_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = pages_of_documents(table(spark, sf_dir, "documents"))
    cores = pages.cores(source.withColumn("n_chars", F.length("text")), keep=("document_sha256", "page", "n_chars"))
    return pages.core_coverage(cores, ("document_sha256", "page"), "n_chars")


Q_CORES = f"SELECT {SHA} AS document_sha256, 1 AS page, CAST(greatest(1, ceil(length(coalesce(text, '')) / {pages.CORE}.0)) AS BIGINT) AS n_cores, true AS complete FROM documents"


def q_core_halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.cores(table(spark, sf_dir, "documents"), keep=("doc_id",)).withColumn("middle_core", pages.owning_core(F.col("core_start"), F.col("core_end")))


Q_CORE_HALOS = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), {pages.CORE})) AS s FROM d), e AS (SELECT *, least(n, s + {pages.CORE}) AS t FROM c)
SELECT doc_id, CAST(s // {pages.CORE} AS INTEGER) AS core, CAST(s AS INTEGER) AS core_start, CAST(t AS INTEGER) AS core_end, CAST(greatest(0, s - {pages.HALO}) AS INTEGER) AS context_start,
  CAST(least(n, t + {pages.HALO}) AS INTEGER) AS context_end, CASE WHEN t > s THEN CAST((s + (t - s - 1) // 2) // {pages.CORE} AS INTEGER) END AS middle_core FROM e"""


def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, null texts as null; without SQL, which has no NFKC."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("normalized_sha256"))


def q_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.significant_words(F.col("text"))).alias("significant"), F.size(T.question_tokens(F.col("text"), compose=False)).alias("question"))


Q_WORD_SETS = f"""
SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({T.STOP_WORDS!r}, w)))) AS INTEGER) AS significant,
  CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS INTEGER) AS question FROM documents"""


def q_numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(digits, K.canonical_number))).alias("number"))
    return docs.groupBy("number").agg(F.count("*").alias("documents"))


Q_NUMERIC = "SELECT n AS number, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\d+'), lambda x: regexp_replace(x, '^0+(\\d)', '\\1')))) AS n FROM documents) GROUP BY n"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.locate_quotes(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


def q_quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir)


Q_QUOTE_LOCATE = "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def q_quote_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = _quotes(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_pages"), F.min("doc_id").alias("first"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(pages_, "item_id", "left").select("item_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.when(F.col("n_pages") == 1, F.col("first")).alias("page"), F.when(F.col("n_pages") == 1, "exact").otherwise("manual_required").alias("method"))


Q_QUOTE_UNIQUE = """
SELECT item_id, count(doc_id) AS n_pages, CASE WHEN count(doc_id) = 1 THEN min(doc_id) END AS page, CASE WHEN count(doc_id) = 1 THEN 'exact' ELSE 'manual_required' END AS method
FROM benchmark b LEFT JOIN (SELECT DISTINCT doc_id, text FROM documents) d ON contains(d.text, b.text) GROUP BY item_id"""


def q_verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document as a quote against the document's own chunks as pages."""
    chunks = _chunks(spark, sf_dir)
    quotes = extract.scope_claims(chunks).select(F.col("document_sha256").alias("candidate_id"), "document_sha256", F.col("quote").alias("evidence_quote"))
    found = citations.verify_citations(quotes, chunks.select("document_sha256", F.col("ordinal").alias("page"), "text"), repair=False, compose=False)
    return found.select("candidate_id", "page", "method", "verified")


SENTENCES_SQL = "list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g') || ' ', '.*?(?:[.!?;:]\\s+|\\s*$)'), lambda s: trim(s)), lambda s: length(s) BETWEEN 20 AND 450)"
Q_VERIFY = f"""
WITH {CHUNKS_SQL}, first AS (
  SELECT document_sha256, arg_min(q, ordinal) AS quote FROM (SELECT document_sha256, ordinal, {SENTENCES_SQL}[1] AS q FROM chunks) WHERE q IS NOT NULL GROUP BY 1
), n AS (SELECT document_sha256, ordinal, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain FROM chunks
), f AS (
  SELECT q.document_sha256, count(*) FILTER (contains(n.text, q.quote)) AS ne, min(n.ordinal) FILTER (contains(n.text, q.quote)) AS pe, count(*) FILTER (contains(n.plain, lower(q.quote))) AS np, min(n.ordinal) FILTER (contains(n.plain, lower(q.quote))) AS pp
  FROM first q JOIN n USING (document_sha256) GROUP BY 1
)
SELECT document_sha256 AS candidate_id, CASE WHEN ne = 1 THEN pe WHEN np = 1 THEN pp END AS page, CASE WHEN ne = 1 THEN 'exact' WHEN np = 1 THEN 'normalized' ELSE 'manual_required' END AS method, ne = 1 OR np = 1 AS verified FROM f"""


def q_local_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.scope_claims(_chunks(spark, sf_dir))


Q_LOCAL_EXTRACT = f"WITH {CHUNKS_SQL} SELECT document_sha256, min(ordinal) AS ordinal, arg_min(q, ordinal) AS quote FROM (SELECT document_sha256, ordinal, {SENTENCES_SQL}[1] AS q FROM chunks) WHERE q IS NOT NULL GROUP BY 1"


def q_qa_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns asked of all documents: the whole corpus is one package."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    questions = turns.select(F.lit("corpus").alias("package_id"), F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.lower("text").alias("question"))
    units = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("package_id"), F.col("doc_id").alias("ord"), F.lower("text").alias("text"), F.lit(1.2).alias("weight"))
    return answers.best_units(questions, units, compose=False).select("question_id", "ord", "overlap", F.round("score", 6).alias("score"))


Q_QA = """
WITH q AS (SELECT DISTINCT concat_ws('-', conv_id, turn) AS question_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS w FROM conversations WHERE role = 'user'),
u AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS w FROM documents),
s AS (SELECT question_id, doc_id, count(*) AS overlap FROM q JOIN u USING (w) GROUP BY ALL)
SELECT question_id, doc_id AS ord, overlap, round(overlap * CAST(1.2 AS DOUBLE), 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, doc_id) = 1"""


def q_question_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("run", F.col("conv_id") % 25)
    return ledgers.limited(asked.select("run", "conv_id", "turn"), "run", ("conv_id", "turn"))


Q_QUESTION_LIMIT = "SELECT conv_id % 25 AS run, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 25 ORDER BY conv_id, turn) <= 10 AS admitted FROM conversations WHERE role = 'user'"


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cost events: user as run, type as provider; every third has an estimate only."""
    amount = ledgers.micro(F.col("value"))
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 5 == 0, "pending").otherwise("succeeded")
    return events.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("provider"), F.concat(F.lit("op"), F.col("event_id") % 2).alias("operation"), status.alias("status"), F.when(F.col("event_id") % 3 != 0, amount).alias("actual_micro_usd"), F.when(F.col("event_id") % 4 != 0, amount + 5).alias("estimated_micro_usd"))


COSTS_SQL = """costs AS (SELECT event_id, ts, user_id AS run_id, event_type AS provider, 'op' || (event_id % 2) AS operation, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 THEN 'pending' ELSE 'succeeded' END AS status,
  CASE WHEN event_id % 3 <> 0 THEN CAST(round(CAST(value AS DECIMAL(20, 6)) * 1000000) AS BIGINT) END AS actual_micro_usd, CASE WHEN event_id % 4 <> 0 THEN CAST(round(CAST(value AS DECIMAL(20, 6)) * 1000000) AS BIGINT) + 5 END AS estimated_micro_usd FROM events)"""


def q_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.cost_rollup(_costs(spark, sf_dir), "provider")


Q_COST_ROLLUP = f"""WITH {COSTS_SQL}, r AS (SELECT provider, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(actual_micro_usd), 0) AS BIGINT) AS actual_micro_usd,
  CAST(sum(CASE WHEN actual_micro_usd IS NULL THEN coalesce(estimated_micro_usd, 0) ELSE 0 END) AS BIGINT) AS estimated_micro_usd, bool_or(status = 'failed') AS any_failed FROM costs GROUP BY provider)
SELECT *, actual_micro_usd + estimated_micro_usd AS total_micro_usd FROM r"""


def q_cost_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.cost_status(_costs(spark, sf_dir), "run_id")


Q_COST_STATUS = f"WITH {COSTS_SQL} SELECT run_id, CASE WHEN bool_or(status = 'pending') THEN 'estimated_pending' WHEN bool_or(actual_micro_usd IS NULL) THEN 'estimated_complete' ELSE 'actual_complete' END AS cost_status FROM costs GROUP BY run_id"


def q_unpriced_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(p, o) for p in ("view", "click", "purchase") for o in ("op0", "op1")], "provider string, operation string")
    return ledgers.unpriced(_costs(spark, sf_dir), expected, "run_id")


Q_UNPRICED = f"""WITH {COSTS_SQL}, e AS (SELECT p AS provider, o AS operation FROM unnest(['view', 'click', 'purchase']) AS a(p), unnest(['op0', 'op1']) AS b(o))
SELECT run_id, provider, operation FROM (SELECT DISTINCT run_id FROM costs), e EXCEPT SELECT run_id, provider, operation FROM costs WHERE coalesce(actual_micro_usd, estimated_micro_usd) IS NOT NULL"""


def _reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    amount = ledgers.micro(F.col("value"))
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("quota_key"), F.col("event_id").alias("run_id"), "ts", amount.alias("amount_micro_usd"), F.when(F.col("event_id") % 2 == 0, F.floor(amount / 2)).alias("settled_micro_usd"))


def q_daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.daily_commitment(_reservations(spark, sf_dir).drop("day"), "quota_key")


Q_DAILY = """WITH r AS (SELECT ts, user_id AS quota_key, event_id, CAST(round(CAST(value AS DECIMAL(20, 6)) * 1000000) AS BIGINT) AS a FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, quota_key, CAST(sum(CASE WHEN event_id % 2 = 0 THEN a // 2 ELSE a END) AS BIGINT) AS committed_micro_usd, count(*) AS runs FROM r GROUP BY ALL"""


def q_budget_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.admit_budgets(_reservations(spark, sf_dir).drop("settled_micro_usd"), 200 * ledgers.MICRO, 2_000 * ledgers.MICRO, 3)


def q_upload_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("quota_day"), F.col("event_id").alias("id"), "ts", (F.col("value") * 1000).cast("long").alias("size_bytes"))
    return ledgers.admit_uploads(uploads, 5, 100_000)


def q_lease_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.leases(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600 * 1000)


Q_LEASES = """WITH g AS (SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fence FROM g)
SELECT user_id, CAST(fence AS BIGINT) AS fence, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS beats FROM f GROUP BY ALL"""


def q_attempt_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _costs(spark, sf_dir).withColumn("attempt_id", F.concat_ws("/", "run_id", "provider"))
    return ledgers.attempts(costs, "attempt_id", F.struct("ts", "event_id"))


Q_ATTEMPTS = f"""WITH {COSTS_SQL}, a AS (SELECT *, run_id || '/' || provider AS attempt_id, row_number() OVER (PARTITION BY run_id, provider ORDER BY ts, event_id) AS n FROM costs),
s AS (SELECT attempt_id, status, actual_micro_usd FROM a WHERE status <> 'pending' QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY n DESC) = 1)
SELECT attempt_id, min(a.ts) AS started_at, coalesce(any_value(s.status), 'pending') AS status, any_value(s.actual_micro_usd) AS actual_micro_usd, count(*) AS n_events FROM a LEFT JOIN s USING (attempt_id) GROUP BY attempt_id"""


def q_state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the states of a run, with the validity of every step."""
    names = list(packages.PROGRESS)
    state = F.element_at(F.array(*map(F.lit, names)), ((F.col("event_id") % len(names)) + 1).cast("int"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("to_state"), (F.col("event_id") % 2 == 0).alias("cleaned"))
    steps = events.withColumn("from_state", F.lag("to_state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("from_state IS NOT NULL")
    return steps.withColumn("valid", packages.valid_transition(F.col("from_state"), F.col("to_state"), F.col("cleaned"))).groupBy("from_state", "to_state").agg(F.count("*").alias("steps"), F.count_if("valid").alias("valid_steps"))


Q_STATES = f"""WITH e AS (SELECT event_id, user_id, ts, ({list(packages.PROGRESS)!r})[CAST(event_id % {len(packages.PROGRESS)} AS INTEGER) + 1] AS to_state FROM events),
s AS (SELECT *, lag(to_state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM e)
SELECT from_state, to_state, count(*) AS steps, count(*) FILTER (from_state = to_state OR (list_contains({[f"{a}>{b}" for a, b in packages.transitions()]!r}, from_state || '>' || to_state) AND (to_state NOT IN ('ready', 'partial') OR event_id % 2 = 0))) AS valid_steps
FROM s WHERE from_state IS NOT NULL GROUP BY ALL"""


def q_heartbeat_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.newest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", F.struct("ts", "event_id"))


Q_HEARTBEAT = "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def q_retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return ledgers.prune_oldest(events, "ts", "event_id", F.lit("2024-01-20").cast("timestamp_ntz"), 1000).select("event_id")


Q_RETENTION = "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 1000)"


def q_idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.sha2(F.floor(F.col("value") / 20).cast("string"), 256).alias("digest"))
    existing, incoming = events.filter("event_id < 500"), events.filter("event_id >= 500")
    return ledgers.insert_if_absent(citations.first_of_each(existing, ("user_id", "event_type"), ("event_id",)), incoming, ("user_id", "event_type"), "digest", "event_id").groupBy("outcome").agg(F.count("*").alias("rows"))


Q_IDEMPOTENT = """WITH e AS (SELECT event_id, user_id, event_type, sha256(CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR)) AS digest FROM events),
o AS (SELECT user_id, event_type, arg_min(digest, event_id) AS old FROM e WHERE event_id < 500 GROUP BY ALL),
i AS (SELECT *, first_value(digest) OVER w AS f, row_number() OVER w AS n FROM e WHERE event_id >= 500 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT CASE WHEN old IS NULL AND n = 1 THEN 'inserted' WHEN coalesce(old, f) = digest THEN 'replayed' ELSE 'conflict' END AS outcome, count(*) AS rows FROM i LEFT JOIN o USING (user_id, event_type) GROUP BY 1"""


def q_canonical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are alike but for their id, as records."""
    drafts = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.lpad((F.col("doc_id") % 400).cast("string"), 6, "0")).alias("id"), F.sha2("text", 256).alias("body"), "lang")
    return records.merge_canonical(drafts, "id").select("id", "lang", "body", "n_records")


Q_CANONICAL = """WITH d AS (SELECT 'r' || lpad(CAST(doc_id % 400 AS VARCHAR), 6, '0') AS id, sha256(text) AS body, lang FROM documents),
m AS (SELECT min(id) AS base, body, lang, count(*) AS n_records FROM d GROUP BY body, lang)
SELECT CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '~' || left(sha256('{"body":"' || body || '","lang":"' || lang || '"}'), 16) ELSE base END AS id, lang, body, n_records FROM m"""


def q_citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("quote"))
    return citations.first_of_each(docs, ("source", "quote"), ("doc_id",))


Q_CITATION_DEDUP = "SELECT min(doc_id) AS doc_id, source, sha256(text) AS quote FROM documents GROUP BY source, sha256(text)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versioned facts: order as package, ship mode as topic, line number as amendment."""
    lines = table(spark, sf_dir, "lineitem")
    first = F.col("l_linenumber") == 1
    return lines.select(F.col("l_orderkey").cast("string").alias("package_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("id"), F.lit("price").alias("topic"), F.concat(F.lit("k"), F.col("l_partkey") % 2).alias("fact_key"), F.concat(F.lit("quantity "), F.col("l_quantity").cast("int")).alias("value"), F.lit("d").alias("document_sha256"), F.when(first, "base").otherwise("amendment").alias("document_role"), F.when(~first, F.lpad((F.floor(F.col("l_linenumber") / 2)).cast("string"), 3, "0")).alias("amendment_number"), F.when(F.col("l_returnflag") == "R", "replace").otherwise("add").alias("effect"), (F.col("l_linestatus") == "F").alias("verified"))


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = facts.reconcile(facts.topic_keys(_versions(spark, sf_dir), compose=False), compose=False)
    return done.groupBy("status", "effect").agg(F.count("*").alias("facts"), F.count_distinct("package_id").alias("packages"))


VERSIONS_SQL = """v AS (
  SELECT l_orderkey AS p, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR)) AS id, l_partkey % 2 AS k, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber // 2 END AS s,
    CASE WHEN l_returnflag = 'R' THEN 'replace' ELSE 'add' END AS effect, l_linestatus = 'F' AS ok, l_linenumber > 1 AS am FROM lineitem
), o AS (SELECT *, row_number() OVER (PARTITION BY p, k ORDER BY s, id) AS n, dense_rank() OVER (PARTITION BY p, k ORDER BY s) AS st FROM v
), a AS (SELECT *, ok AND (effect = 'add' OR (am AND n > 1)) AS valid FROM o
), b AS (SELECT *, coalesce(max(CASE WHEN valid AND effect <> 'add' THEN st END) OVER (PARTITION BY p, k), 0) AS last FROM a
), c AS (SELECT *, valid AND st >= last AS cur FROM b
), d AS (SELECT *, count(DISTINCT CASE WHEN cur THEN q END) OVER (PARTITION BY p, k, st) AS vs, count(DISTINCT CASE WHEN cur THEN q END) OVER (PARTITION BY p, k) AS vg FROM c
), e AS (SELECT *, bool_or(cur AND vs > 1) OVER (PARTITION BY p, k) AS anystage FROM d
), r AS (SELECT *, CASE WHEN NOT cur THEN 'superseded' WHEN vs > 1 OR (NOT anystage AND vg > 1) THEN 'conflicted' ELSE 'active' END AS status FROM e)"""
Q_RECONCILE = f"WITH {VERSIONS_SQL} SELECT status, effect, count(*) AS facts, count(DISTINCT p) AS packages FROM r GROUP BY ALL"


def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = facts.reconcile(facts.topic_keys(_versions(spark, sf_dir), compose=False), compose=False)
    return facts.conflicts(done).select("package_id", "id", F.size("candidate_values").alias("n_values"), "safe_answer")


Q_CONFLICTS = f"""WITH {VERSIONS_SQL}, x AS (SELECT * FROM r WHERE status = 'conflicted'), l AS (SELECT p, k, CASE WHEN any_value(anystage) THEN max(CASE WHEN vs > 1 THEN st END) END AS st FROM x GROUP BY p, k)
SELECT CAST(p AS VARCHAR) AS package_id, 'conflict-owned-k' || k AS id, CAST(count(DISTINCT q) AS INTEGER) AS n_values,
  CASE WHEN bool_and(s > -1) THEN 'The supplied amendment' WHEN bool_and(s = -1) THEN 'The supplied document' ELSE 'The supplied package' END || ' is internally inconsistent; clarification is required.' AS safe_answer
FROM x JOIN l USING (p, k) WHERE l.st IS NULL OR l.st = x.st GROUP BY p, k"""


def q_cleanup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose shipped lines stand for deletion receipts: an order is clean once every supplier of it has one."""
    lines = table(spark, sf_dir, "lineitem")
    return records.divided(lines, lines.filter("l_linestatus = 'F'"), "l_orderkey", "l_suppkey")


Q_CLEANUP = """WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), d AS (SELECT DISTINCT l_orderkey, l_suppkey, true AS have FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, count(*) AS n_expected, count(have) AS n_present, count(*) = count(have) AS complete FROM e LEFT JOIN d USING (l_orderkey, l_suppkey) GROUP BY 1"""


def q_key_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against documents: missing, unknown and duplicate ids by reason."""
    given = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.col("toxic") * 100_000_000).alias("doc_id"))
    return records.reconcile_keys(table(spark, sf_dir, "documents"), given, "doc_id").groupBy("reason").agg(F.count("*").alias("n"))


Q_KEYS = """WITH g AS (SELECT doc_id + toxic * 100000000 AS doc_id, count(*) AS n FROM labels GROUP BY 1), d AS (SELECT doc_id, count(*) AS m FROM documents GROUP BY 1)
SELECT CASE WHEN m IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS reason, count(*) AS n FROM d FULL OUTER JOIN g USING (doc_id) GROUP BY 1"""


def q_balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return pages.balanced_batches(docs, 4, ("source",), ("doc_id",)).groupBy("source", "batch").agg(F.count("*").alias("parts"), F.sum("n_chars").alias("chars"))


Q_BALANCED = "SELECT source, batch, count(*) AS parts, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT source, n_chars, CAST(ntile(4) OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS batch FROM documents) GROUP BY ALL"


def q_output_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 97).alias("floor"), (F.col("n_chars") % 89).alias("used"))
    return pages.output_caps(docs, 5000, "floor", "used", ("source",), ("doc_id",)).select("doc_id", "output_cap")


Q_CAPS = """SELECT doc_id, CAST(greatest(5000 - coalesce(sum(n_chars % 89) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  - coalesce(sum(n_chars % 97) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 0) AS BIGINT) AS output_cap FROM documents"""


def q_packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return pages.packed_batches(docs, "source", ("doc_id",), "n_chars", 20_000)


def q_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.fragments(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "ordinal", "fragment_start", F.length("text").alias("chars"))


def q_reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("kept")
    return records.reason_counts(labelled, "lang", reason, ("unlabelled", "toxic", "poor", "kept"))


Q_REASONS = """SELECT lang, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0 AND toxic <> 1) AS poor, count(*) FILTER (quality = 1 AND toxic <> 1) AS kept
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""


def q_group_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.group_digest(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


Q_DIGEST = """SELECT n_regionkey, sha256(string_agg(j, chr(10) ORDER BY j)) AS digest FROM (SELECT n_regionkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS j FROM nation) GROUP BY 1"""


def q_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of conversations' turns against spans of the same conversation that overlap."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 300).alias("start"), (F.col("turn") * 300 + F.length("text")).alias("end"))
    return citations.overlapping(turns, turns, ("conv_id",), width=256).filter("l_turn < r_turn").select("conv_id", "l_turn", "r_turn")


Q_OVERLAP = "WITH t AS (SELECT conv_id, turn, turn * 300 AS s, turn * 300 + length(text) AS e FROM conversations WHERE length(text) > 0) SELECT a.conv_id, a.turn AS l_turn, b.turn AS r_turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.s < b.e AND a.e > b.s"

SQL = {
    "q_chunks": Q_CHUNKS, "q_cores_coverage": Q_CORES, "q_core_halos": Q_CORE_HALOS, "q_word_sets": Q_WORD_SETS, "q_numeric_tokens": Q_NUMERIC, "q_quote_locate": Q_QUOTE_LOCATE,
    "q_quote_unique": Q_QUOTE_UNIQUE, "q_verify_citations": Q_VERIFY, "q_local_extract": Q_LOCAL_EXTRACT, "q_qa_top1": Q_QA, "q_question_limit": Q_QUESTION_LIMIT, "q_cost_rollup": Q_COST_ROLLUP, "q_cost_status": Q_COST_STATUS,
    "q_unpriced_operations": Q_UNPRICED, "q_daily_budget": Q_DAILY, "q_lease_gaps": Q_LEASES, "q_attempt_settle": Q_ATTEMPTS, "q_state_transitions": Q_STATES, "q_heartbeat_newest": Q_HEARTBEAT, "q_retention_prune": Q_RETENTION,
    "q_idempotent_insert": Q_IDEMPOTENT, "q_canonical_merge": Q_CANONICAL, "q_citation_dedup": Q_CITATION_DEDUP, "q_reconcile": Q_RECONCILE, "q_conflicts": Q_CONFLICTS, "q_cleanup_gate": Q_CLEANUP, "q_key_reconciliation": Q_KEYS,
    "q_balanced_batches": Q_BALANCED, "q_output_caps": Q_CAPS, "q_reason_pivot": Q_REASONS, "q_group_digest": Q_DIGEST, "q_span_overlap": Q_OVERLAP,
}

#: Sequential folds, recursive splits and NFKC, which SQL does not express; tested against plain loops.
WITHOUT_SQL = (q_normalize, q_budget_admit, q_upload_admit, q_packed_batches, q_fragments)
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in WITHOUT_SQL}
