"""Every registered query with SQL equals it on the smallest tables."""

import hashlib
import math
import os
import re
import unicodedata

import duckdb
import pytest

from factloom.operators import answers
from factloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())
    assert sorted(names) == columns
    assert mine == theirs
    assert mine or name in ("q_quote_locate", "q_conflicts", "q_unpriced_operations")


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, SF).limit(1).count() == 1


def test_whole_questions_meet_all_documents(spark, monkeypatch):
    """Against brute force, in one cell and in many: the best document has the least id of all with the most words of the whole question."""
    words = lambda t: {w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) >= 3}
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").collect()
    wanted = {}
    for r in turns:
        asked = words(r["text"])
        overlap, ord_ = max((len(asked & told), -i) for i, told in docs.items())
        if overlap:
            wanted[f"{r['conv_id']}-{r['turn']}"] = (-ord_, overlap)
    assert any(len(r["text"]) > 200 for r in turns)
    for most in (answers.CELL_UNITS, 30):
        monkeypatch.setattr(answers, "CELL_UNITS", most)
        monkeypatch.setattr(answers, "CELL_QUESTIONS", most)
        found = catalog.queries()["q_qa_top1"](spark, SF).collect()
        assert len(found) == len(wanted) and {r["question_id"]: (r["ord"], r["overlap"]) for r in found} == wanted


def test_every_document_is_normalised(spark, tmp_path):
    """Against plain Python: on a driver table, and on texts with each character that is folded."""

    def wanted(text):
        if text is None:
            return None
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c not in "\u00ad\u200b\u200c\u200d\ufeff")
        text = text.translate(dict.fromkeys(range(0x2010, 0x2016), "-") | dict.fromkeys((0x201C, 0x201D), '"') | dict.fromkeys((0x2018, 0x2019), "'"))
        return hashlib.sha256(" ".join(text.split()).lower().encode()).hexdigest()

    odd = [*(f"A{chr(c)}B  c" for c in (*range(0xA0, 0x250), *range(0x2000, 0x2070), 0x3000, 0xFB01, 0xFEFF, 0xFF21, 0x1D400)), "e\u0301 \u2460 x\u00b2", "", " \n\t ", None]
    rows = [(i, t) for i, t in enumerate(odd) if t is None or not set(t) & set("\x85\u0130")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (SF, str(tmp_path)):
        docs = {r["doc_id"]: wanted(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        found = catalog.queries()["q_normalize"](spark, folder).collect()
        assert len(found) == len(docs) and {r["doc_id"]: r["normalized_sha256"] for r in found} == docs
    assert docs[odd.index("A\u2011B  c")] == docs[odd.index("A\u2013B  c")]
