"""Edge cases of decisions, alignment and keys, against plain loops where there is no SQL."""

from pyspark.sql import functions as F

from factloom.operators import adjudication, alignment, coverage, evaluation, fact_keys
from factloom.sources import staging


def test_ledger_units_own_each_mention_once(spark):
    texts = ["", None, "Send by email or fax. " * 400, "x" * 2695 + " e-mail to a@b.ca", "No way to send.", "fax " * 11]
    pages = spark.createDataFrame([(1, f"d{i}", 1, t) for i, t in enumerate(texts)], "package_id int, document_sha256 string, page int, text string")
    rows = adjudication.ledger_units(pages).collect()
    assert len({r["candidate_id"] for r in rows}) == len(rows) == sum(max(1, -(-len(t or "") // 2700)) for t in texts)
    for i, text in enumerate(texts):
        found = coverage.channel_mentions(text)
        mine = sorted((r["core"], r["n_mentions"], r["channel"], r["capacity"]) for r in rows if r["document_sha256"] == f"d{i}")
        for core, n, channel, capacity in mine:
            owned = [c for c, a, b in found if (a + (b - a - 1) // 2) // 2700 == core]
            assert (n, channel) == (len(owned), owned[0] if len(owned) == 1 else "unspecified")
            assert capacity == (0 if not text else max(1, min(10, n)))


def test_selectors_take_white_space_as_alike(spark):
    cases = [("a b  c", "a b"), ("a\n\tb a b", "a b"), ("aaa", "aa"), ("", "a"), (None, "a"), ("a", None), ("a", ""), ("a b", " b"), ("x" * 600, "x" * 501), ("a" + " " * 600 + "b", "a b")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, q string")
    found = {r["i"]: r for r in rows.select("i", alignment.selectors(F.col("t"), F.col("q")).alias("s"), alignment.occurrences(F.col("t"), F.col("q")).alias("o")).collect()}
    spans = [None if found[i]["s"] is None else [tuple(x) for x in found[i]["s"]] for i in range(len(cases))]
    assert spans == [[(0, 3)], [(0, 4), (5, 8)], [(0, 2), (1, 3)], [], None, None, None, None, None, None]
    assert [len(found[i]["o"]) for i in range(len(cases))] == [1, 1, 2, 0, 0, 0, 0, 1, 100, 0]


def test_threshold_and_weight_wording(spark):
    quotes = ["a minimum score of 35 out of 50 is required", "70 points is the minimum", "bids must achieve 60 points", "technical 70 % price 30 %", "technical merit 70% and price 30%", "it may be at least 10", "", None]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(quotes)], "i int, q string")
    least, scale = evaluation.threshold_values(F.col("q"))
    got = rows.select(least.alias("least"), scale.alias("scale"), evaluation.weight_values(F.col("q"), "technical_weight").alias("tech"), evaluation.weight_values(F.col("q"), "financial_weight").alias("price")).orderBy("i").collect()
    assert [r["least"] for r in got] == [[35.0], [70.0], [60.0], [], [], [], [], None]
    assert [r["scale"] for r in got] == [[50.0], [], [], [], [], [], [], None]
    assert got[4]["tech"] == [70.0] and got[4]["price"] == [30.0] and got[3]["tech"] == [70.0]


def test_keys_of_nothing(spark):
    facts = spark.createDataFrame([], "package_id int, id int, topic string, value string, document_sha256 string, fact_key string")
    citations = spark.createDataFrame([], "package_id int, id int, document_sha256 string, evidence_quote string, verified boolean")
    assert fact_keys.closed_keys(facts, citations).count() == 0
    one = spark.createDataFrame([(1, 1, None, None, None, None)], facts.schema)
    nothing = spark.createDataFrame([(1, 1, None, None, True)], citations.schema)
    assert [r["fact_key"] for r in fact_keys.closed_keys(one, nothing).collect()] == [None]
    assert [r["lineage"] for r in fact_keys.risk_lineage(one.drop("topic", "fact_key"), nothing).collect()] == ["unbound"]


def test_segments_and_insurance_lists(spark):
    text = "The insurance contact is Ann and deductible is 5, certificate is due. Call at 5 p.m. today"
    row = spark.createDataFrame([(text.lower(),)], "t string").select(fact_keys.segments(F.col("t")).alias("s")).first()
    assert row["s"] == ["the insurance contact is ann", "insurance deductible is 5", "insurance certificate is due", "call at 5 p.m. today"]


def test_composed_texts(spark):
    """With NFKC on: full-width digits in the source are the value's."""
    facts = spark.createDataFrame([(1, 1, "t", "12", "d", None), (1, 2, "t", "March 3, 2021", "d", None)], "package_id int, id int, topic string, value string, document_sha256 string, fact_key string")
    citations = spark.createDataFrame([(1, 1, "d", "The insurance deductible is \uff11\uff12.", True), (1, 2, "d", "Bids must be received by March 3, 2021.", True)], "package_id int, id int, document_sha256 string, evidence_quote string, verified boolean")
    assert {r["id"]: r["fact_key"] for r in fact_keys.closed_keys(facts, citations).collect()} == {1: "insurance:deductible", 2: "deadline:solicitation"}
    rules = spark.createDataFrame([(1, 1, "technical_weight", "70%"), (1, 2, "selection_method", "Best value"), (1, 3, "financial_weight", "30%"), (1, 4, "rated_threshold", None)], "package_id int, rule_id int, field string, value string")
    quotes = [(1, 1, "Technical merit is worth \uff17\uff10%.", True), (1, 2, "The award is based on best value.", True), (1, 3, "Price is worth 40%.", True), (1, 4, None, True)]
    done = evaluation.validated_rules(rules, spark.createDataFrame(quotes, "package_id int, rule_id int, evidence_quote string, verified boolean"))
    assert {r["rule_id"]: r["valid"] for r in done.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_adjudication_does_its_joins_once(spark, monkeypatch):
    """Units by line and batch: a stray decision, an answer in other order, a repeated span and spans without an end; what is read twice is staged."""
    names = []
    monkeypatch.setattr(adjudication, "stage", lambda df, name: names.append(name) or staging.stage(df, name))
    units = spark.createDataFrame([(1, f"u{i}", "s", i, 2, 0, 2700, 0, 2950) for i in range(6)], "package_id int, candidate_id string, document_sha256 string, page int, capacity int, core_start int, core_end int, source_start int, source_end int")
    headers = spark.createDataFrame([(1, False, True, 1, 1, True)], "package_id int, capacity_exceeded boolean, packing_complete boolean, expected_pages int, covered_pages int, metadata_complete boolean")
    sent = {1: ["u0", "u1"], 2: ["u2", "u3"], 3: ["u4"], 4: ["u5"]}
    batches = spark.createDataFrame([(1, b, ids, "d", ["f"], False) for b, ids in sent.items()], "package_id int, batch_id int, candidate_ids array<string>, ledger_digest string, fragment_ids array<string>, tainted boolean")
    answers = spark.createDataFrame([(1, b, "d", ids[::-1] if b == 2 else ids, ["f"]) for b, ids in sent.items()], "package_id int, batch_id int, ledger_digest string, candidate_ids array<string>, fragment_ids array<string>")
    decisions = spark.createDataFrame([(1, b, u, "s", int(u[1]), "relevant") for b, ids in sent.items() for u in ids] + [(1, 2, "u9", "s", 0, "relevant"), (1, 3, "u0", "s", 0, "relevant")], "package_id int, batch_id int, candidate_id string, document_sha256 string, page int, coverage string")
    relation = lambda b, u, n, a: (1, b, u, n, a, a + 5, None, None, 0.9, "whole_bid", "required", "email")
    relations = spark.createDataFrame([relation(1, "u0", 1, 0), relation(1, "u0", 2, 0), relation(1, "u1", 1, 0), relation(1, "u1", 2, 9)], "package_id int, batch_id int, candidate_id string, ordinal int, relation_start int, relation_end int, condition_start int, condition_end int, confidence double, subject_scope string, modality string, channel string")
    records, summed = adjudication.adjudicated(headers, units, batches, answers, decisions, relations)
    assert {r["candidate_id"]: (r["reason"], r["n_relations"]) for r in records.collect()} == {
        "u0": ("overlap_disagreement", 0), "u1": (None, 2), "u2": ("batch_manifest_mismatch", 0), "u3": ("batch_manifest_mismatch", 0), "u4": ("unknown_candidate", 0), "u5": (None, 0)
    }
    (head,) = summed.collect()
    assert (head["expected_units"], head["verified_units"], head["expected_batches"], head["verified_batches"], head["verified_fragments"], head["complete"]) == (6, 2, 4, 1, 3, False)
    assert head["reasons"] == "batch_manifest_mismatch,overlap_disagreement,unknown_candidate" and set(names) == {"transport", "stray", "judged"}
