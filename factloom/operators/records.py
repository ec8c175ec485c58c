"""Merging drafts: canonical records, first and longest values, batches against responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import canonical_json_digest

ID_CHARS, DIGEST_CHARS = 180, 16


def merge_canonical(records: DataFrame, record_id: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Records alike but for their id become one with the smallest id; ids that several then share get a digest added."""
    body = [c for c in records.columns if c != record_id]
    merged = records.withColumn("digest", canonical_json_digest(*body)).groupBy(*body, "digest").agg(F.min(record_id).alias("_base"), F.count("*").alias("n_records"))
    shared = F.count("*").over(Window.partitionBy(*keys, "_base"))
    distinct = F.concat(F.substring("_base", 1, ID_CHARS), F.lit("~"), F.substring("digest", 1, DIGEST_CHARS))
    return merged.withColumn(record_id, F.when(shared > 1, distinct).otherwise(F.col("_base"))).drop("_base")


def first_populated(value: str, order: Column) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull() & (F.col(value) != ""), order))


def last_populated(value: str, order: Column) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull() & (F.col(value) != ""), order))


def longest(value: str, order: Column) -> Column:
    """The longest value, the earliest of several."""
    return F.max_by(value, F.struct(F.length(value), -order))


def reconcile_keys(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Each key with what is wrong about it: missing, unknown or duplicate; null if nothing is."""
    left = expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    right = given.groupBy(key).agg(F.count("*").alias("n_given"))
    reason = F.when(F.col("n_expected").isNull(), "unknown").when(F.col("n_given").isNull(), "missing").when(F.col("n_given") > 1, "duplicate")
    return left.join(right, key, "full_outer").select(key, reason.alias("reason"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The new row where there is one for the key, the last by ``order`` of several, else the old."""
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def _tallied(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """Per group and item how often either side has it (_l, _r), by one aggregation of both; nulls of the sides are not the same item."""
    side = lambda df, l, r: df.select(group, item, F.lit(l).alias("_a"), F.lit(r).alias("_b"))  # noqa: E731, E741
    return side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(group, item).agg(F.sum("_a").alias("_l"), F.sum("_b").alias("_r")).withColumn("_keyed", F.col(group).isNotNull() & F.col(item).isNotNull())


def without(rows: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """The rows whose key is not among ``gone``, and of each child table those that do not refer to one that is."""
    ids = gone.select(key)  # an anti join takes repeated keys as they are
    return [rows.join(ids, key, "left_anti"), *[child.join(ids.withColumnRenamed(key, ref), ref, "left_anti") for child, ref in children]]


def bounded_union(left: DataFrame, right: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """Both tables' distinct rows; an error if a group has more than ``most``, as none may be cut off."""
    merged = left.unionByName(right).distinct()
    sizes = merged.groupBy(*keys).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_size", F.when(F.col("_size") > most, F.raise_error(F.concat(F.lit("more rows than "), F.lit(most)))).otherwise(F.col("_size")))
    return merged.join(sizes, list(keys)).filter("_size >= 0").drop("_size")


def recovered_first(model: DataFrame, recovered: DataFrame, key: tuple[str, ...], record_id: str) -> DataFrame:
    """Recovered rows, and the model's rows that have neither the key nor the id of one; ``recovered`` tells which is which."""
    rest = model.join(recovered.select(*key).distinct(), list(key), "left_anti").join(recovered.select(record_id).distinct(), record_id, "left_anti")
    return recovered.withColumn("recovered", F.lit(True)).unionByName(rest.withColumn("recovered", F.lit(False)))


def same_multisets(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """Per group whether both sides list the same items, each once."""
    return _tallied(left, right, group, item).groupBy(group).agg(F.bool_and(F.col("_keyed") & (F.col("_l") == 1) & (F.col("_r") == 1)).alias("same"))


def ordered_union(rows: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """Per group its items once each, in the order in which they first come."""
    firsts = rows.groupBy(group, item).agg(F.min(order).alias("_at"))
    return firsts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item))), lambda x: x[item]).alias("items"))


def matched(records: DataFrame, annotations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Records with how many annotations they have under the keys: one is right, none missing, several duplicate."""
    counts = annotations.groupBy(*keys).agg(F.count("*").alias("n_annotations"))
    n = F.coalesce("n_annotations", F.lit(0))
    return records.join(counts, list(keys), "left").withColumn("n_annotations", n).withColumn("match", F.when(n == 1, "one").when(n == 0, "missing").otherwise("duplicate"))


def coverage_header(expected: DataFrame, verified: DataFrame, reasons: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: expected and verified items, and complete if they are as many and nothing is unresolved."""
    want = expected.groupBy(group).agg(F.count_distinct(item).alias("expected"))
    have = expected.select(group, item).distinct().join(verified.select(group, item).distinct(), [group, item]).groupBy(group).agg(F.count("*").alias("verified"))
    open_ = reasons.groupBy(group).agg(F.count("*").alias("unresolved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    header = want.join(have, group, "left").join(open_, group, "left").select(group, "expected", zero("verified"), zero("unresolved"))
    return header.withColumn("complete", (F.col("expected") == F.col("verified")) & (F.col("unresolved") == 0))


def worst(rows: DataFrame, group: str, value: str, ranks: tuple[str, ...], *flags: str) -> DataFrame:
    """Per group the worst of the values by their rank in ``ranks`` (best first), and whether any and all rows have each flag."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(value))
    return rows.groupBy(group).agg(F.max_by(value, rank).alias(value), *[f(flag).alias(f"{name}_{flag}") for flag in flags for name, f in (("any", F.bool_or), ("all", F.bool_and))])


def most_complete(rows: DataFrame, group: str, tokens: str, order: str) -> DataFrame:
    """Per group the row with the most tokens, the first by ``order`` of several."""
    window = Window.partitionBy(group).orderBy(F.desc(F.size(tokens)), order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def chosen_batch(fits: DataFrame, item: str) -> DataFrame:
    """Per item the batch to put it in: one that has its document already, then the smallest, then the first (contains, bytes, batch)."""
    window = Window.partitionBy(item).orderBy(F.desc("contains"), "bytes", "batch")
    return fits.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def json_bytes(*cols: str) -> Column:
    """The length in UTF-8 bytes of the columns written as JSON."""
    return F.octet_length(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}))


def divided(expected: DataFrame, present: DataFrame, group: str, item: str) -> DataFrame:
    """Per group of ``expected``: whether all its items are present. Groups without expected items do not appear."""
    wanted = _tallied(expected, present, group, item).filter("_l > 0")
    return wanted.groupBy(group).agg(F.count("*").alias("n_expected"), F.count_if(F.col("_keyed") & (F.col("_r") > 0)).alias("n_present")).withColumn("complete", F.col("n_expected") == F.col("n_present"))


def reason_counts(rows: DataFrame, group: str, reason: Column, reasons: tuple[str, ...]) -> DataFrame:
    """A column of counts per reason, by group."""
    return rows.groupBy(group).agg(*[F.count_if(reason == r).alias(r) for r in reasons])


def group_digest(rows: DataFrame, group: str, *cols: str) -> DataFrame:
    """SHA-256 over the group's rows in order, each written as JSON with sorted keys."""
    lines = F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(cols)))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
