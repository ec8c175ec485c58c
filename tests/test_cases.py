"""Rows with the same texts are judged once."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import cases, evaluation, fact_keys, facts, mutations, risks

N = 40


def test_cases_of_rows_and_their_proof(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, None), (3, 1, None), (3, 2, "a")], "package_id int, id int, value string")
    proof = spark.createDataFrame([(1, 1, "q", 1), (1, 1, "p", 2), (1, 2, "p", 8), (1, 2, "q", 7), (2, 1, "q", 3), (2, 2, None, 1), (3, 1, None, 4), (9, 9, "q", 1)], "package_id int, id int, quote string, page int")
    members, each, shown = cases.cases(rows, ["package_id", "id"], ["value"], proof, ["quote"], F.col("page"))
    of = {(r["package_id"], r["id"]): r["_case"] for r in members.collect()}
    assert len(of) == 6 and of[1, 1] == of[1, 2] and of[2, 2] == of[3, 1] and len(set(of.values())) == each.count() == 4
    texts = {r["id"]: r["value"] for r in each.collect()}
    assert texts[of[1, 1]] == texts[of[3, 2]] == "a" and texts[of[2, 2]] is None
    listed = sorted((r["id"], r["citation"], r["quote"]) for r in shown.filter("quote IS NOT NULL").collect())
    assert listed == sorted([(of[1, 1], 0, "q"), (of[1, 1], 1, "p"), (of[2, 1], 0, "q")]) and shown.count() == 4


def _facts(spark, **cols):
    return spark.range(N).select((F.col("id") % 7).alias("package_id"), "id", F.lit("d").alias("document_sha256"), *[F.lit(v).alias(k) for k, v in cols.items()])


def _cited(spark, quote):
    return _facts(spark, evidence_quote=quote, verified=True, citation=0, page=1)


def rights(spark):
    changed = _facts(spark, fact_key="insurance:deductible", value="9", effect="replace", stage=1, role="amendment")
    base = changed.withColumns({"id": -1 - F.col("package_id"), "effect": F.lit("add"), "stage": F.lit(0), "value": F.lit("5")}).distinct()
    return mutations.mutation_rights(base.unionByName(changed), _cited(spark, "The insurance deductible is hereby amended from 5 to 9."), compose=False).filter("authorised AND effect = 'replace'")


def parts(spark):
    return risks.risk_parts(_facts(spark, finding="The insurance deductible is 9", impact="Costs rise", action="Ask"), _cited(spark, "The insurance deductible is 9."), compose=False).filter("part = 'finding' AND lineage = 'bound'")


def lineage(spark):
    return fact_keys.risk_lineage(_facts(spark, value="The insurance deductible is 9"), _cited(spark, "The insurance deductible is 9."), compose=False).filter("lineage = 'bound'")


def deadlines(spark):
    return fact_keys.deadline_keys(_facts(spark, value="May 3, 2021"), _cited(spark, "Bids must be received by May 3, 2021."), compose=False).filter("deadline_key = 'deadline:solicitation'")


def sources(spark):
    return fact_keys.source_keys(_facts(spark, topic="", value="9"), _cited(spark, "The insurance deductible is 9."), compose=False).filter("source_key = 'insurance:deductible'")


def rules(spark):
    each = _facts(spark, field="technical_weight", value="60%").withColumnRenamed("id", "rule_id")
    return evaluation.validated_rules(each, _cited(spark, "The technical weight is 60%.").withColumnRenamed("id", "rule_id"), compose=False).filter("valid AND n_bound = 1")


@pytest.mark.parametrize(
    "made, module, judge",
    [(rights, mutations, "_evidence_rights"), (parts, risks, "_judged_parts"), (lineage, fact_keys, "judged_lineage"), (deadlines, fact_keys, "_judged_deadlines"), (sources, fact_keys, "_judged_sources"), (rules, evaluation, "_judged_rules")],
)
def test_rows_with_the_same_texts_are_judged_once(spark, monkeypatch, made, module, judge):
    real, seen = getattr(module, judge), []
    monkeypatch.setattr(module, judge, lambda rows, *rest: seen.append(rows.count()) or real(rows, *rest))
    assert made(spark).count() == N and seen == [1]


def _judges(plan: str) -> bool:
    return "regexp_extract_all" in plan


def test_values_of_facts_are_read_once_each(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(facts, "stage", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    topics = _facts(spark, key="owned:k", value="quantity 9", effect="add", verified=True, document_role="base", amendment_number=None)
    assert facts.reconcile(topics, compose=False).filter("status = 'active'").count() == N
    assert seen and not any(map(_judges, seen))
