import pytest
from pyspark.sql import functions as F

from factloom.operators import mutations

FACT = "package_id int, id int, fact_key string, value string, effect string, stage int, role string, document_sha256 string"
CITED = "package_id int, id int, citation int, document_sha256 string, page int, evidence_quote string, verified boolean"

# value, effect, key, evidence in pages, whether the source gives the right
CASES = [
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible is hereby amended from 5,000 to 7,500."], True),
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible is replaced by 7,500; all else remains unchanged."], True),
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible may be amended to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["If funding is approved, the insurance deductible is amended to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible is not amended to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["It isn't so that the insurance deductible is changed to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible is amended to 7,500.", "That amendment has been withdrawn."], False),
    ("7,500", "replace", "insurance:deductible", ["Is the insurance deductible amended to 7,500?"], False),
    ("7,500", "replace", "insurance:deductible", ["A vendor requests that the insurance deductible is amended to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["The insurance deductible is amended to 7,500.", "The insurance deductible is amended to 9,000."], False),
    ("9,000", "replace", "insurance:deductible", ["The insurance deductible is amended to 7,500.", "The insurance deductible is amended to 9,000."], True),
    ("5,000", "replace", "insurance:deductible", ["The insurance deductible is amended from 5,000 to 7,500."], False),
    ("7,500", "replace", "insurance:contact", ["The insurance deductible is amended to 7,500."], False),
    ("7,500", "replace", "insurance:deductible", ["The insurance contact is amended to Ann Lee, deductible remains unchanged at 7,500."], False),
    ("CAD 7,500", "replace", "insurance:deductible", ["The insurance deductible is amended to CAD 7,500 or USD 6,000."], False),
    ("7,500", "replace", None, ["The insurance deductible is amended to 7,500."], False),
    ("5,000", "delete", "insurance:deductible", ["The insurance deductible of 5,000 is hereby deleted."], True),
    ("5,000", "delete", "insurance:deductible", ["The insurance deductible of 5,000 could be deleted."], False),
    ("5,000", "delete", "insurance:deductible", ["The insurance deductible of 5,000 is deleted. It was later reinstated."], False),
    ("May 3, 2027", "replace", "deadline:solicitation", ["The closing date is extended to May 3, 2027."], True),
    ("May 3, 2027", "replace", "deadline:solicitation", ["The date shown is extended from May 1, 2027 until May 3, 2027."], True),
    ("May 3, 2027", "replace", "deadline:questions", ["The closing date is extended to May 3, 2027."], False),
    ("May 3, 2027", "replace", "deadline:solicitation", ["The closing date is expected to be extended to May 3, 2027."], False),
    ("anything", "add", "insurance:deductible", ["No words of it."], True),
    (None, "replace", "insurance:deductible", [None], False),
]


@pytest.mark.parametrize("compose", [True, False])
def test_rights_in_plain_language(spark, compose):
    facts = [(p, 1, key, value, effect, 1, "amendment", "D") for p, (value, effect, key, _, _) in enumerate(CASES)] + [(p, 0, c[2], "5,000", "add", 0, "base", "b") for p, c in enumerate(CASES)]
    cited = [(p, 1, n, "d", n + 1, q, True) for p, c in enumerate(CASES) for n, q in enumerate(c[3])]
    found = mutations.mutation_rights(spark.createDataFrame(facts, FACT), spark.createDataFrame(cited, CITED), compose)
    got = {r["package_id"]: r["authorised"] for r in found.filter("id = 1").collect()}
    assert [(CASES[p][3], got[p]) for p in range(len(CASES))] == [(c[3], c[4]) for c in CASES]
    assert found.filter("id = 0 AND NOT authorised").count() == 0


def test_rights_need_sound_evidence_and_an_earlier_fact(spark):
    quote = "The insurance deductible is amended to 7,500."
    fact = lambda p, **of: tuple({"package_id": p, "id": 1, "fact_key": "insurance:deductible", "value": "7,500", "effect": "replace", "stage": 1, "role": "amendment", "document_sha256": "d", **of}.values())
    facts = [fact(p) for p in range(4)] + [fact(4, role="base"), fact(5)] + [(p, 0, "insurance:deductible", "5", "add", 0, "base", "b") for p in range(5)] + [(6, 0, None, None, None, None, None, None)]
    cited = [(0, 1, 0, "d", 1, quote, True), (1, 1, 0, "d", 1, quote, False), (2, 1, 0, "x", 1, quote, True), (3, 1, 0, "d", None, quote, True), (4, 1, 0, "d", 1, quote, True), (5, 1, 0, "d", 1, quote, True)]
    found = mutations.mutation_rights(spark.createDataFrame(facts, FACT), spark.createDataFrame(cited, CITED))
    assert {r["package_id"] for r in found.filter("effect = 'replace' AND authorised").collect()} == {0}
    assert mutations.mutation_rights(spark.createDataFrame([], FACT), spark.createDataFrame([], CITED)).count() == 0


def test_the_last_target_by_page_citation_and_sentence(spark):
    facts = [(1, 1, None, "x", "replace", 1, "amendment", "d"), (1, 2, None, "x", "replace", 1, "amendment", "d"), (1, 3, None, "x", "delete", 1, "amendment", "d")]
    cited = [(1, 1, 0, "d", 2, "It is changed to two. It is changed to three.", True), (1, 1, 1, "d", 1, "It is changed to one.", True), (1, 2, 0, "d", 9, "It is changed to nine.", True), (1, 2, 1, "d", None, "It is changed to ten. Nothing else.", True), (1, 3, 0, "d", 1, "It is changed to one.", True)]
    last = mutations.terminal_targets(spark.createDataFrame(facts, FACT), spark.createDataFrame(cited, CITED)).collect()
    assert {r["id"]: r["terminal"] for r in last} == {1: "three.", 2: "ten"}


def test_scopes_of_a_clause(spark):
    text = "the insurance contact is amended to ann, deductible is unchanged and certificate is deleted while the fee stays"
    row = spark.createDataFrame([(text, "replace")], "t string, e string").select(mutations.clause_scopes(F.col("t")).alias("s")).first()
    assert row["s"] == ["the insurance contact is amended to ann", "insurance deductible is unchanged", "insurance certificate is deleted", "the fee stays"]
    linked = spark.createDataFrame([(["if so", "it is amended"], "replace"), (["clause 4 is deleted", "in its entirety and replaced"], "replace"), (["a", "b"], "delete")], "s array<string>, e string")
    got = [r["x"] for r in linked.select(mutations._linked(F.col("s"), F.col("e")).alias("x")).collect()]
    assert got == [["if so", "if so, it is amended"], ["clause 4 is deleted", "clause 4 is deleted in its entirety and replaced"], ["a", "b"]]
