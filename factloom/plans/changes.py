"""Queries on changes of facts and on risks over the driver tables, each with equal SQL.

Orders' lines stand for amendments, worded in turn in ways that affirm a change or do not; line numbers are their stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import predicates
from factloom.functions.tokens import assertion_tokens
from factloom.operators import citations, fact_keys, facts, materialize, mutations, risks
from factloom.sources.tables import table

from .judgements import SOURCED_SQL, _by, _sourced, _worded

#: Only the first and the last wording give the right to the change.
WORDINGS = (
    "The insurance deductible is hereby amended from 5 to 9#.",
    "The insurance deductible may be amended to 9#.",
    "The insurance deductible isn't amended to 9#.",
    "The insurance deductible is amended to 9#. This amendment was withdrawn.",
    "The insurance deductible is amended to 9#. The insurance deductible is amended to 3.",
    "If approved, the insurance deductible is amended to 9#.",
    "The insurance contact is amended to Ann while the insurance deductible is unchanged at 9#.",
    "The insurance deductible is replaced by 9#, all told.",
)


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _sourced(spark, sf_dir)
    kinds = F.floor(F.col("m") / 8) + F.col("id")
    key, document = F.lit("insurance:deductible"), F.lit("d")
    amended = lines.select("package_id", "id", key.alias("fact_key"), _worded("9#", F.col("q")).alias("value"), F.lit("replace").alias("effect"), F.col("id").cast("int").alias("stage"), F.lit("amendment").alias("role"), document.alias("document_sha256"))
    base = lines.select("package_id").distinct().select("package_id", F.lit(0).cast(lines.schema["id"].dataType).alias("id"), key.alias("fact_key"), F.lit("5").alias("value"), F.lit("add").alias("effect"), F.lit(0).alias("stage"), F.lit("base").alias("role"), document.alias("document_sha256"))
    cited = lines.select("package_id", "id", F.lit(0).alias("citation"), document.alias("document_sha256"), F.lit(1).alias("page"), _by(kinds, *[_worded(t, F.col("q")) for t in WORDINGS]).alias("evidence_quote"), (kinds % 7 != 0).alias("verified"))
    return base.unionByName(amended), cited


def q_mutation_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.mutation_rights(*_changes(spark, sf_dir), compose=False).select("package_id", "id", "effect", "authorised")


RIGHTS_SQL = f"""{SOURCED_SQL}, k AS (SELECT package_id, id, (m // 8 + id) % 8 IN (0, 7) AND (m // 8 + id) % 7 <> 0 AS ok FROM l),
r AS (SELECT package_id, id, 'replace' AS effect, ok AS authorised FROM k UNION ALL SELECT DISTINCT package_id, 0, 'add', true FROM l)"""
Q_RIGHTS = f"{RIGHTS_SQL} SELECT * FROM r"


def q_authorised_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the facts come to if each changes others only by the right that its evidence gives."""
    judged = mutations.mutation_rights(*_changes(spark, sf_dir), compose=False)
    staged = judged.select("package_id", "id", F.concat(F.lit("owned:"), "fact_key").alias("key"), "value", "effect", "authorised", F.col("role").alias("document_role"), F.when(F.col("stage") > 0, F.col("stage").cast("string")).alias("amendment_number"), "document_sha256", F.lit(True).alias("verified"))
    return facts.reconcile(staged, compose=False).select("package_id", "id", "status")


Q_CHANGES = f"""{RIGHTS_SQL}, t AS (SELECT package_id, coalesce(max(id) FILTER (authorised AND effect = 'replace'), 0) AS last FROM r GROUP BY 1)
SELECT package_id, id, CASE WHEN id = last THEN 'active' ELSE 'superseded' END AS status FROM r JOIN t USING (package_id)"""


def _parted_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, q = _sourced(spark, sf_dir), F.col("q")
    kinds = F.floor(F.col("m") / 8) + F.col("id")
    finding = _by(kinds, _worded("The insurance deductible is #", q), F.lit("Parking is scarce"))
    impact = _by(kinds % 3, F.lit("Costs rise"), _worded("Claims of # fall under the insurance deductible", q), _worded("Losses of # are near", q))
    each = lines.select("package_id", "id", finding.alias("finding"), impact.alias("impact"), F.lit("Ask the broker").alias("action"), F.lit("d").alias("document_sha256"))
    cited = lines.select("package_id", "id", F.lit("d").alias("document_sha256"), F.concat(_worded("The insurance deductible is #. Parking is scarce. Claims of # fall under the insurance deductible.", q)).alias("evidence_quote"), F.lit(True).alias("verified"))
    return risks.risk_parts(each, cited, compose=False)


def q_risk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parted_risks(spark, sf_dir).select("package_id", "id", "part", "lineage", F.array_join("keys", ",").alias("keys"))


Q_PARTS = f"""{SOURCED_SQL}, k AS (SELECT package_id, id, (m // 8 + id) % 2 = 0 AS bound, (m // 8 + id) % 3 AS i FROM l), p AS (SELECT *, unnest(['finding', 'impact', 'action']) AS part FROM k),
s AS (SELECT package_id, id, part, CASE part WHEN 'finding' THEN bound WHEN 'action' THEN bound ELSE CASE i WHEN 0 THEN bound WHEN 1 THEN true ELSE false END END AS b FROM p)
SELECT package_id, id, part, CASE WHEN b THEN 'bound' ELSE 'unbound' END AS lineage, CASE WHEN b THEN 'insurance:deductible' ELSE '' END AS keys FROM s"""


def q_risk_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line stands for a superseded amount of the deductible, some for one in conflict."""
    status = F.when((F.col("package_id") % 9 == 0) & (F.col("id") == 1), "conflicted").when(F.col("id") % 2 == 1, "superseded").otherwise("active")
    known = _sourced(spark, sf_dir).select("package_id", F.lit("insurance:deductible").alias("fact_key"), _worded("#", F.col("q")).alias("value"), status.alias("status"))
    return risks.risk_dependencies(_parted_risks(spark, sf_dir), known, compose=False)


Q_DEPENDENCIES = f"""{SOURCED_SQL}, f AS (SELECT package_id, q, CASE WHEN package_id % 9 = 0 AND id = 1 THEN 'conflicted' WHEN id % 2 = 1 THEN 'superseded' ELSE 'active' END AS status FROM l),
d AS (SELECT DISTINCT package_id FROM f WHERE status = 'conflicted'),
g AS (SELECT package_id, q FROM f WHERE package_id NOT IN (SELECT package_id FROM d) GROUP BY 1, 2 HAVING bool_or(status = 'superseded') AND NOT bool_or(status = 'active')),
k AS (SELECT package_id, id, q, (m // 8 + id) % 2 = 0 AS bound, (m // 8 + id) % 3 AS i FROM l)
SELECT k.package_id, k.id, CASE WHEN g.q IS NULL THEN 'none' WHEN bound THEN 'stale' WHEN i > 0 THEN 'mixed' ELSE 'none' END AS dependency FROM k LEFT JOIN g USING (package_id, q)"""

def q_critical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the groups of their customer, their lines as citations: verified when shipped, on a page unless returned."""
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package_id"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linestatus") == "F").alias("verified"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("page"))
    return materialize.critical_groups(groups, groups.join(lines, "id"))


Q_CRITICAL = """WITH c AS (SELECT l_orderkey AS id, bool_and(l_linestatus = 'F' AND l_returnflag <> 'R') AS cited FROM lineitem GROUP BY 1)
SELECT o_custkey AS package_id, count(DISTINCT o_orderkey) AS critical_groups, count(DISTINCT o_orderkey) FILTER (cited) AS cited_groups FROM orders LEFT JOIN c ON o_orderkey = id GROUP BY 1"""

def q_cited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines are verified and on a page, and those that also have one part only."""
    line = F.struct((F.col("l_linestatus") == "F").alias("verified"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("page"), (F.col("l_partkey") % 2).cast("string").alias("document_sha256"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("citations"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).cast("string").alias("document")).join(lines, "o_orderkey", "left")
    return orders.select("o_orderkey", citations.all_verified().alias("verified"), citations.all_verified(document="document").alias("of_document"))


Q_CITED = """WITH c AS (SELECT l_orderkey AS k, bool_and(l_linestatus = 'F' AND l_returnflag <> 'R') AS v, bool_and(l_partkey % 2 = l_orderkey % 2) AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(v, false) AS verified, coalesce(v AND d, false) AS of_document FROM orders LEFT JOIN c ON o_orderkey = k"""


def q_same_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines as asserted against those of a source that has the day, the day and an hour, or an hour and a zone."""
    day = F.col("q") % 28 + 1
    kinds = F.floor(F.col("m") / 8) + F.col("id")
    source = _by(kinds, _worded("closes May #, 2021", day), _worded("closes May #, 2021 at 14:00", day), _worded("closes May #, 2021 at 14:00 EST", day))
    said = _by(F.floor(kinds / 3), _worded("May #, 2021", day), _worded("May #, 2021 at 14:00", day), _worded("May #, 2021 at 14:00 EST", day), F.lit("at 14:00"))
    asked = _sourced(spark, sf_dir).select("package_id", "id", said.alias("said"), source.alias("source"))
    told = fact_keys.once(asked, ["said"], _said=assertion_tokens(F.col("said"), False))
    told = fact_keys.once(told, ["source"], _source=assertion_tokens(F.col("source"), False))
    return told.select("package_id", "id", fact_keys.same_deadline(F.col("_said"), F.col("_source")).alias("same"))


Q_DEADLINES = f"""{SOURCED_SQL}, k AS (SELECT package_id, id, (m // 8 + id) % 3 AS s, ((m // 8 + id) // 3) % 4 AS a FROM l)
SELECT package_id, id, (s = 0 AND a = 0) OR (s = 1 AND a IN (1, 2)) OR (s = 2 AND a = 2) AS same FROM k"""


def q_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page addresses could be request keys, and which are on one host by HTTPS."""
    return table(spark, sf_dir, "pages").select("page_id", predicates.valid_request_key(F.col("url")).alias("valid_key"), predicates.allowed_url(F.col("url"), HOST).alias("allowed"))


HOST = "blog.tionsh.example.net"
Q_KEYS = rf"""SELECT page_id, coalesce(trim(url) = '', true) OR regexp_full_match(trim(url), '[\x21-\x7e]{{8,200}}') AS valid_key,
  coalesce(regexp_matches(url, '(?i)^https://{HOST}(:443)?([/?#].*)?$'), false) AS allowed FROM pages"""


def q_blocking_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not known of each customer: a positive balance, an order, an open order; the first and the last are told alike."""
    open_ = F.max(F.col("o_orderstatus") == "O").alias("open")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), open_)
    packages = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").withColumnRenamed("c_custkey", "package_id")
    tests = (("means", F.col("c_acctbal") <= 0), ("orders", F.col("n").isNull()), ("means", ~F.coalesce("open", F.lit(False))))
    found = materialize.blocking_unknowns(packages, *tests)
    return found.select("package_id", F.array_join("unknowns", ",").alias("unknowns"))


Q_UNKNOWNS = """WITH o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'O') AS open FROM orders GROUP BY 1)
SELECT c_custkey AS package_id, array_to_string(list_filter([CASE WHEN c_acctbal <= 0 OR NOT coalesce(open, false) THEN CASE WHEN c_acctbal <= 0 THEN 'means' END END, CASE WHEN k IS NULL THEN 'orders' END,
  CASE WHEN c_acctbal > 0 AND NOT coalesce(open, false) THEN 'means' END], lambda x: x IS NOT NULL), ',') AS unknowns FROM customer LEFT JOIN o ON c_custkey = k"""

QUERIES = {f.__name__: f for f in (q_mutation_rights, q_authorised_changes, q_risk_parts, q_risk_dependencies, q_critical_groups, q_cited_orders, q_same_deadlines, q_request_keys, q_blocking_unknowns)}
SQL = {"q_mutation_rights": Q_RIGHTS, "q_authorised_changes": Q_CHANGES, "q_risk_parts": Q_PARTS, "q_risk_dependencies": Q_DEPENDENCIES, "q_critical_groups": Q_CRITICAL, "q_cited_orders": Q_CITED, "q_same_deadlines": Q_DEADLINES, "q_request_keys": Q_KEYS, "q_blocking_unknowns": Q_UNKNOWNS}
