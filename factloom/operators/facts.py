"""Versioned facts: grouping, stages, mutation rights, supersession and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import normalised, topic_tokens
from factloom.functions.tokens import assertion_tokens
from factloom.sources.staging import stage

from .fact_keys import once

LAST = 2**53 - 1
#: Shared topic words, and the share of all or of the shorter topic's words, from which two topics are one.
ALIAS_WORDS, ALIAS_JACCARD, ALIAS_CONTAINED = 2, 0.45, 0.75

# Words of a topic that have to agree where both topics have one.
STRUCTURES = ("annex", "appendix", "row", "section", "table")
DOMAINS = ("closing", "delivery", "financial", "insurance", "security", "technical")


def stage_columns(role: Column, amendment: Column) -> tuple[Column, Column]:
    """The number and the label of a document's stage; the base comes first, unnumbered amendments last."""
    number = F.regexp_extract(amendment, r"\d+", 0)
    # A number beyond any amendment's sorts with the unnumbered ones.
    rank = F.when(role == "base", F.lit(-1)).when(number.try_cast("long").isNotNull(), number.try_cast("long")).otherwise(F.lit(LAST))
    return rank.cast("long"), F.when(role == "base", F.lit("")).otherwise(F.lower(F.coalesce(amendment, F.lit(""))))


def topic_keys(facts: DataFrame, compose: bool = True) -> DataFrame:
    """Adds ``key``: the given fact_key, or else the sorted words of the topic."""
    owned = F.concat(F.lit("owned:"), normalised(F.col("fact_key"), compose))
    return facts.withColumn("key", F.coalesce(owned, F.array_join(F.array_sort(topic_tokens(F.col("topic"), compose)), ":")))


def alias_pairs(facts: DataFrame, compose: bool = True) -> DataFrame:
    """(package_id, key, other): topics of added scalar facts that are worded differently but the same.

    Two aliases share two words at least, so pairs are made of topics that share a pair of words.
    """
    words = topic_tokens(F.col("topic"), compose)
    topics = facts.filter((F.col("effect") == "add") & F.col("fact_key").isNull() & (F.size(assertion_tokens(F.col("value"), compose)) > 0))
    topics = topics.select("package_id", "key", F.array_sort(words).alias("words")).dropDuplicates(["package_id", "key"])
    two = topics.select("*", F.explode("words").alias("one")).select("*", F.explode("words").alias("other_word")).filter("one < other_word")
    left = two.select("package_id", "one", "other_word", F.col("key"), F.col("words"))
    right = two.select("package_id", "one", "other_word", F.col("key").alias("other"), F.col("words").alias("other_words"))
    pairs = left.join(right, ["package_id", "one", "other_word"]).filter("key < other").dropDuplicates(["package_id", "key", "other"])
    shared = F.size(F.array_intersect("words", "other_words"))

    def agree(pick) -> Column:
        a, b = pick("words"), pick("other_words")
        return (F.size(a) == 0) | (F.size(b) == 0) | (a == b)

    numbers = lambda c: F.filter(c, lambda w: w.rlike(r"^\d+$"))
    structures = lambda c: F.array_intersect(F.array(*map(F.lit, STRUCTURES)), F.col(c))
    domains = lambda c: F.array_intersect(F.array(*map(F.lit, DOMAINS)), F.transform(c, lambda w: F.when(w == "price", "financial").otherwise(w)))
    close = (shared / F.size(F.array_union("words", "other_words")) >= ALIAS_JACCARD) | (shared / F.least(F.size("words"), F.size("other_words")) >= ALIAS_CONTAINED)
    return pairs.filter((shared >= ALIAS_WORDS) & close & agree(numbers) & agree(structures) & agree(domains)).select("package_id", "key", "other")


def merged_keys(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts whose keys are connected by alias pairs get the smallest of the connected keys.

    Labels spread along the pairs and then jump to their labels' labels until none changes, which takes few rounds; the pairs are few beside the facts.
    """
    both = pairs.unionByName(pairs.select("package_id", F.col("other").alias("key"), F.col("key").alias("other")))
    labels = both.select("package_id", "key").distinct().withColumn("label", F.col("key"))
    while True:
        near = both.join(labels.withColumnRenamed("key", "other").withColumnRenamed("label", "near"), ["package_id", "other"]).groupBy("package_id", "key").agg(F.min("near").alias("near"))
        spread = labels.join(near, ["package_id", "key"]).select("package_id", "key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select("package_id", F.col("key").alias("label"), F.col("label").alias("jumped"))
        spread = spread.join(jump, ["package_id", "label"], "left").select("package_id", "key", "old", F.coalesce("jumped", "label").alias("label"))
        spread = stage(spread, "labels")
        labels = spread.drop("old")
        if spread.filter("label != old").isEmpty():
            break
    return facts.join(labels, ["package_id", "key"], "left").withColumn("key", F.coalesce("label", "key")).drop("label")


def with_rights(facts: DataFrame) -> DataFrame:
    """Adds ``authorised`` where it is not given (by mutations.mutation_rights): additions always; others only from an amendment, verified, and over an earlier fact of the same key."""
    if "authorised" in facts.columns:
        return facts
    order = Window.partitionBy("package_id", "key").orderBy("stage_number", "stage_label", "document_sha256", "id")
    earlier = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    allowed = (F.col("document_role") == "amendment") & F.col("verified") & earlier
    return facts.withColumn("authorised", (F.col("effect") == "add") | allowed)


def reconcile(facts: DataFrame, compose: bool = True) -> DataFrame:
    """Adds stage, authorised and status (active, superseded or conflicted) to facts with key and verified.

    A stage with a verified, authorised replacement or deletion supersedes all before it. Verified and authorised
    values that stand are conflicted if they differ within a stage that replaces or has scalar values, or else as a whole
    if all have scalar values and these differ.
    """
    number, label = stage_columns(F.col("document_role"), F.col("amendment_number"))
    told = once(facts, ["value"], value_key=normalised(F.col("value"), compose), scalars=F.array_join(assertion_tokens(F.col("value"), compose), "|"))
    staged = with_rights(told.withColumns({"stage_number": number, "stage_label": label}))
    group, in_stage = Window.partitionBy("package_id", "key"), Window.partitionBy("package_id", "key", "stage")
    ordered = staged.withColumn("stage", F.dense_rank().over(group.orderBy("stage_number", "stage_label")))
    valid = F.col("verified") & F.col("authorised")
    last = F.coalesce(F.max(F.when(valid & (F.col("effect") != "add"), F.col("stage"))).over(group), F.lit(0))
    marked = ordered.withColumns({"current": valid & (F.col("effect") != "delete") & (F.col("stage") >= last), "owned": F.col("key").startswith("owned:") | F.col("key").startswith("derived:")})
    marked = stage(marked, "marked")  # so that stages are made once, not for each window below
    now = lambda c: F.when(F.col("current"), c)

    def several(c: str, window) -> Column:
        return F.min(now(F.col(c))).over(window) != F.max(now(F.col(c))).over(window)

    def differ(window) -> Column:
        return F.bool_and(now(F.col("owned") & (F.col("scalars") != ""))).over(window) & several("scalars", window)

    replaced = F.bool_or(now(F.col("effect") == "replace")).over(in_stage) & F.bool_and(now(F.col("owned"))).over(in_stage)
    tested = marked.withColumns({"stage_conflict": F.coalesce(F.col("current") & several("value_key", in_stage) & (replaced | differ(in_stage)), F.lit(False)), "whole_conflict": F.coalesce(F.col("current") & differ(group), F.lit(False))})
    any_stage = F.bool_or("stage_conflict").over(group)
    status = F.when(~F.col("current"), "superseded").when(F.col("stage_conflict") | (~any_stage & F.col("whole_conflict")), "conflicted").otherwise("active")
    return tested.withColumn("status", status).drop("current", "owned", "scalars", "stage_conflict", "whole_conflict")


def conflicts(reconciled: DataFrame) -> DataFrame:
    """One row per conflicted key: id, topic, the differing values and a safe answer. Of several stages the last is reported."""
    clashing = stage(reconciled.filter("status = 'conflicted'"), "conflicted")
    order = F.struct("stage_number", "stage_label", "document_sha256", "id")
    last = clashing.groupBy("package_id", "key").agg(F.max("stage").alias("_last"), F.count_distinct("stage").alias("_stages"))
    within = clashing.groupBy("package_id", "key", "stage").agg(F.count_distinct("value_key").alias("_values"))
    kept = clashing.join(within, ["package_id", "key", "stage"]).join(last, ["package_id", "key"]).filter((F.col("_values") == 1) | (F.col("stage") == F.col("_last")) | (F.col("_stages") == 1))
    first = kept.groupBy("package_id", "key", "value_key").agg(F.min_by("value", order).alias("value"), F.min(order).alias("order"), F.min_by("topic", order).alias("topic"), F.collect_set("document_sha256").alias("documents"), F.collect_set("document_role").alias("roles"))
    rows = first.groupBy("package_id", "key").agg(F.min_by("topic", "order").alias("topic"), F.transform(F.array_sort(F.collect_list(F.struct("order", "value"))), lambda x: x["value"]).alias("candidate_values"), F.array_distinct(F.flatten(F.collect_list("documents"))).alias("documents"), F.array_distinct(F.flatten(F.collect_list("roles"))).alias("roles"))
    single = (F.size("documents") == 1) & (F.size("roles") == 1)
    who = F.when(single & F.array_contains("roles", "amendment"), "amendment").when(single & F.array_contains("roles", "base"), "document").otherwise("package")
    slug = F.substring(F.regexp_replace(F.regexp_replace("key", "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)
    answer = F.concat(F.lit("The supplied "), who, F.lit(" is internally inconsistent; clarification is required."))
    return rows.select("package_id", F.concat(F.lit("conflict-"), F.when(slug == "", "topic").otherwise(slug)).alias("id"), "topic", "candidate_values", answer.alias("safe_answer"))


def reconcile_together(collections: dict[str, DataFrame], compose: bool = True) -> DataFrame:
    """Facts of several collections (claims, requirements) reconciled once more as one package, with ``collection``.

    A value superseded or conflicted by a fact of another collection is so in its own; facts without a right to change
    others need review.
    """
    named = [df.withColumns({"collection": F.lit(name), "id": F.concat(F.lit(name + ":"), "id")}) for name, df in collections.items()]
    together = named[0]
    for df in named[1:]:
        together = together.unionByName(df)
    done = reconcile(together, compose)
    own = F.expr("substring(id, length(collection) + 2)")
    return done.withColumns({"id": own, "status": F.when(F.col("authorised"), F.col("status")).otherwise("needs_review")})


def supported_conflicts(conflicts: DataFrame, citations: DataFrame, origins: DataFrame, discarded: DataFrame) -> DataFrame:
    """The conflicts (package_id, id) with two citations or more, all verified and on a page, and no origin that was discarded.

    ``citations`` has these keys, verified and page; ``origins`` has them and origin, as ``discarded`` has package_id and origin.
    """
    keys = ["package_id", "id"]
    cited = citations.groupBy(keys).agg(F.count("*").alias("_n"), F.bool_and(F.col("verified") & F.col("page").isNotNull()).alias("_all")).filter("_n >= 2 AND _all")
    gone = origins.join(discarded.select("package_id", "origin").distinct(), ["package_id", "origin"], "left_semi").select(*keys).distinct()
    return conflicts.join(cited.select(*keys), keys, "left_semi").join(gone, keys, "left_anti")
