from factloom.operators import fact_keys, risks

FINDING = "package_id int, id int, value string, document_sha256 string"
CITED = "package_id int, id int, document_sha256 string, evidence_quote string, verified boolean"


def lineages(spark, rows):
    """(finding, quote, verified, document) -> lineage and keys."""
    findings = spark.createDataFrame([(1, i, f, "d") for i, (f, *_) in enumerate(rows)], FINDING)
    citations = spark.createDataFrame([(1, i, d, q, v) for i, (_, q, v, d) in enumerate(rows)], CITED)
    return [(r["lineage"], r["keys"]) for r in fact_keys.risk_lineage(findings, citations).orderBy("id").collect()]


def test_findings_in_plain_language(spark):
    rows = [
        ("Bids close in September", "Bids close 2026-09-15.", True, "d"),
        ("Bids close", "Bids close 2026-09-15.", True, "d"),
        ("Questions are due on Monday", "Questions are due by 5 p.m. EST.", True, "d"),
        ("September 2026", "Bids close September 2026.", True, "d"),  # nothing but a date
        ("Bids close in September", "Bids close 2026-09-15.", False, "d"),
        ("Bids close in September", "Bids close 2026-09-15.", True, "other"),
        ("Bids close early", "Bids close 2026-09-15.", True, "d"),
        ("The insurance deductible is CAD 5,000 but questions are due in May", "The insurance deductible is CAD 5,000. All questions are due May 1.", True, "d"),
        ("The insurance deductible is high but parking is scarce", "The insurance deductible is high.", True, "d"),
        ("The projection extends to 2040", "The projection extends to 2040, all told", True, "d"),
        ("The cut-off is near", "The cut-off is near.", True, "d"),
        ("Parking is scarce", "Parking is scarce.", True, "d"),
        (None, None, True, "d"),
        ("", "Bids close 2026-09-15.", True, "d"),
    ]
    both = ["deadline:questions", "deadline:solicitation"]
    assert lineages(spark, rows) == [
        ("bound", [both[1]]), ("bound", [both[1]]), ("bound", [both[0]]), ("unbound", []), ("unbound", []), ("unbound", []), ("unbound", []),
        ("ambiguous", [both[0], "insurance:deductible"]), ("unbound", []), ("bound", ["projection:horizon"]), ("ambiguous", both), ("unbound", []), ("unbound", []), ("unbound", []),
    ]


def test_parts_and_what_they_depend_on(spark):
    quote = "The insurance deductible is 5000 dollars. Parking is scarce. Claims of 5000 dollars fall under the insurance deductible."
    rows = [
        # finding, impact, action, dependency
        ("The insurance deductible is 5000 dollars", "Costs rise", "Ask the broker", "stale"),
        ("The insurance deductible is dollars", "Costs rise", "Claims of 5000 dollars fall under the insurance deductible", "stale"),
        ("Parking is scarce", "Claims of 5000 dollars fall under the insurance deductible", "Ask", "mixed"),
        ("Parking is scarce", "Losses of 5000 dollars", "Ask", "mixed"),
        ("Parking is scarce", "Losses of 7000 dollars", "Ask", "none"),
        ("Parking is scarce for 5000 dollars", "Costs rise", "Ask", "none"),
        ("The insurance deductible is 5000 dollars", None, "", "stale"),
    ]
    table = spark.createDataFrame([(1, i, *r[:3], "d") for i, r in enumerate(rows)], "package_id int, id int, finding string, impact string, action string, document_sha256 string")
    cited = spark.createDataFrame([(1, i, "d", quote, True) for i in range(len(rows))], CITED)
    facts = spark.createDataFrame([(1, "insurance:deductible", "superseded", "5000 dollars"), (1, "insurance:deductible", "active", "6000 dollars"), (2, "insurance:deductible", "superseded", "7000")], "package_id int, fact_key string, status string, value string")
    parts = risks.risk_parts(table, cited)
    found = {(r["id"], r["part"]): (r["lineage"], r["keys"]) for r in parts.collect()}
    assert found[0, "impact"] == ("bound", ["insurance:deductible"]) and found[3, "impact"] == ("unbound", []) and found[1, "action"] == ("bound", ["insurance:deductible"])
    assert [r["dependency"] for r in risks.risk_dependencies(parts, facts).orderBy("id").collect()] == [r[3] for r in rows]
    disputed = facts.union(spark.createDataFrame([(1, "insurance:deductible", "conflicted", None)], facts.schema))
    assert {r["dependency"] for r in risks.risk_dependencies(parts, disputed).collect()} == {"none"}
    two = spark.createDataFrame([(1, 1, "The insurance deductible is 5000 but the closing date is near", None, None, "d")], table.schema)
    proof = spark.createDataFrame([(1, 1, "d", "The insurance deductible is 5000. The closing date is near.", True)], CITED)
    assert [r["dependency"] for r in risks.risk_dependencies(risks.risk_parts(two, proof), facts).collect()] == ["ambiguous"]
    assert risks.risk_dependencies(risks.risk_parts(table.limit(0), cited), facts).count() == 0
