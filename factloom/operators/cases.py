"""Rows that say the same and have the same proof are one case, which is judged once.

Texts of statements and of their evidence repeat over packages, and what is decided by texts alone need not be decided for
each row anew. A case has its own package_id and id, so that it takes the place of a row in the operators.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.staging import stage


def cases(rows: DataFrame, keys: list[str], says: list[str], proof: DataFrame, shows: list[str], order: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, cases, shown): the rows with the ``id`` of their case, the distinct cases of the columns ``says``, and their proof.

    Members keep their keys and have ``_case``; cases have package_id, id and says; shown has these two, ``citation`` (the
    place in the list of the case's proof, by ``order`` and then by the columns ``shows``) and shows.
    """
    whole = F.struct((F.lit(0) if order is None else order).alias("_order"), *shows)
    lists = proof.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(whole)), lambda x: F.struct(*[x[c].alias(c) for c in shows])).alias("_proof"))
    told = stage(rows.select(*keys, *says).join(lists, keys, "left"), "told")
    same = [*says, "_proof"]
    numbered = stage(told.select(*same).distinct().withColumn("_case", F.monotonically_increasing_id()), "cases")
    known = numbered.withColumnsRenamed({c: "_of" + c for c in same})
    members = told.join(known, reduce(and_, [told[c].eqNullSafe(known["_of" + c]) for c in same])).select(*keys, "_case")
    each = numbered.withColumns({"package_id": F.lit(0), "id": F.col("_case")})
    shown = each.select("package_id", "id", F.posexplode("_proof").alias("citation", "_shown")).select("package_id", "id", "citation", "_shown.*")
    return members, each.select("package_id", "id", *says), shown
