from pyspark.sql import functions as F

from factloom.operators import materialize
from factloom.sources import tables


def test_names_are_composed_before_they_are_checked(spark):
    names = ["a.pdf", " Ａ．pdf ", "résumé.PDF", "a\x00b\x7f.pdf", ".pdf", "a/b.pdf", "a\\b.pdf", "a／b.pdf", "x.txt", "", None, "ﬁ" * 98 + ".pdf", "ﬁ" * 99 + ".pdf"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r["c"] for r in rows.select("i", tables.checked_name(F.col("n")).alias("c")).orderBy("i").collect()]
    assert got == ["a.pdf", "A.pdf", "résumé.PDF", "ab.pdf", None, None, None, None, None, None, None, "fi" * 98 + ".pdf", None]


def test_groups_are_cited_if_all_citations_hold(spark):
    groups = spark.createDataFrame([(1, "c", "a"), (1, "c", "a"), (1, "c", "b"), (1, "r", "a"), (1, "r", "x"), (2, "c", "n"), (3, None, None)], "package_id int, kind string, id string")
    cited = spark.createDataFrame([(1, "c", "a", True, 1), (1, "c", "a", True, 2), (1, "c", "b", True, None), (1, "r", "a", True, 1), (1, "r", "a", False, 1), (1, "z", "z", True, 1), (2, "c", "n", None, 1)], "package_id int, kind string, id string, verified boolean, page int")
    got = {r["package_id"]: (r["critical_groups"], r["cited_groups"]) for r in materialize.critical_groups(groups, cited).collect()}
    assert got == {1: (4, 1), 2: (1, 0), 3: (1, 0)}
