"""Queries on places in texts over the driver tables: aligned layout, contexts and shown values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import layout
from factloom.sources.tables import table


def q_layout_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with layout marks put in is a fragment, its lines as they were are the pages; each line without marks of its own is looked up."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = docs.select("document", F.posexplode("lines").alias("page", "text"))
    even = lambda page: page % 2 == 0
    marked = F.transform("lines", lambda x, page: F.when(even(page), F.concat(F.lit("## "), x)).otherwise(F.concat(F.lit("**"), x, F.lit("**"))))
    fragments = docs.repartition("document").select(F.col("document").alias("fragment_id"), "document", F.array_join(marked, "\n").alias("text"))
    # Where a line starts is told by the lengths of those before it: no text is shuffled for that.
    plain = ~F.col("text").rlike(r"[#*_|`\\]") & (F.length("text") <= layout.LONGEST) & (F.trim("text") != "")
    sizes = lines.select("document", "page", F.length("text").alias("n"), plain.alias("plain"))
    before = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.sum(F.col("n") + F.when(even(F.col("page")), 4).otherwise(5)).over(before)
    start = (F.coalesce(ends, F.lit(0)) + F.when(even(F.col("page")), 3).otherwise(2)).cast("int")
    placed = sizes.withColumn("start", start).filter("plain")
    selectors = placed.select(F.concat_ws("-", "document", "page").alias("selector_id"), F.col("document").alias("fragment_id"), "start", (F.col("start") + F.col("n")).alias("end"))
    found = layout.resolved_spans(selectors, fragments, lines)
    return found.select("selector_id", "n_places", "page", "start", F.sha2("quote", 256).alias("quote_sha256"))


LAYOUT_SQL = r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS page FROM documents),
seen AS MATERIALIZED (SELECT doc_id, page, text, trim(regexp_replace(translate(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '‐‑‒–—―“”‘’', '------""'''''), '\s+', ' ', 'g')) AS value FROM lines),
asked AS (SELECT * FROM seen WHERE NOT regexp_matches(text, '[#*_|`\\]') AND length(text) <= 500 AND trim(text) <> ''),
met AS (SELECT a.doc_id, a.page, sum(len(list_filter(range(1, length(b.value) - length(a.value) + 2), lambda i: substr(b.value, i, length(a.value)) = a.value))) AS n FROM asked a JOIN seen b ON a.doc_id = b.doc_id AND contains(b.value, a.value) GROUP BY 1, 2)
SELECT doc_id || '-' || asked.page AS selector_id, CAST(n AS BIGINT) AS n_places, CASE WHEN n = 1 THEN CAST(asked.page AS INTEGER) END AS page, CASE WHEN n = 1 THEN CAST(length(text) - length(ltrim(text)) AS INTEGER) END AS start,
  CASE WHEN n = 1 THEN sha256(trim(text)) END AS quote_sha256
FROM asked JOIN met USING (doc_id, page)"""


def q_sentence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around the middle of every document, and what leads to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("a"))
    cols = F.col("text"), F.col("a"), F.least(F.col("a") + 10, F.length("text"))
    return docs.select("doc_id", F.sha2(layout.sentence_context(*cols), 256).alias("sentence_sha256"), F.sha2(layout.heading_context(*cols), 256).alias("heading_sha256"))


CONTEXTS_SQL = r"""WITH p AS (SELECT doc_id, text, CAST(length(text) // 2 AS INTEGER) AS a, least(length(text) // 2 + 10, length(text)) AS b FROM documents),
c AS (SELECT *, substr(text, 1, a) AS before, substr(text, b + 1) AS after FROM p),
d AS (SELECT *, regexp_replace(before, '\s+$', '') AS lead, CASE WHEN strpos(reverse(before), ' .') > 0 THEN length(before) - strpos(reverse(before), ' .') + 1 ELSE 0 END AS s1, CASE WHEN strpos(reverse(before), ' ;') > 0 THEN length(before) - strpos(reverse(before), ' ;') + 1 ELSE 0 END AS s2,
  length(regexp_extract(after, '^((?s).*?[.;])(\s|$)', 1)) AS stop FROM c),
e AS (SELECT *, regexp_replace(lead, '[.;:]\s*$', '') AS bare, greatest(s1, s2) AS begins FROM d),
f AS (SELECT *, greatest(CASE WHEN strpos(reverse(bare), ' .') > 0 THEN length(bare) - strpos(reverse(bare), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(bare), ' ;') > 0 THEN length(bare) - strpos(reverse(bare), ' ;') - 1 ELSE -1 END) AS prior, greatest(0, length(lead) - 300) AS least_ FROM e),
g AS (SELECT *, CASE WHEN length(lead) = 0 THEN a WHEN prior >= least_ THEN prior + 2 ELSE least_ END AS h FROM f)
SELECT doc_id, sha256(trim(substr(text, begins + 1, CASE WHEN stop > 0 THEN b + stop ELSE length(text) END - begins))) AS sentence_sha256, sha256(trim(substr(text, h + 1, b - h))) AS heading_sha256 FROM g"""


def q_shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's first three words in bold as a value of two origins; the page of the second has them for even items only."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.substring_index("text", " ", 3).alias("words"))
    value = F.concat(F.lit("**"), "words", F.lit("**"))
    marked = F.concat(value, F.substring(F.col("text"), F.length("words") + 1, F.length("text")))
    first = items.select("item_id", value.alias("value"), F.col("text").alias("quote"), marked.alias("source"))
    second = items.select("item_id", value.alias("value"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("quote"), marked.alias("source"))
    return layout.presented(first.unionByName(second), ["item_id"])


SHOWN_SQL = r"""WITH w AS (SELECT item_id, text, array_to_string(string_split(text, ' ')[1:3], ' ') AS words FROM benchmark),
s AS (SELECT *, words LIKE '%' || chr(10) || '%' AS broken FROM w)
SELECT item_id, CASE WHEN item_id % 2 = 0 AND NOT broken THEN words ELSE '**' || words || '**' END AS shown, item_id % 2 = 0 AND NOT broken AS projected FROM s"""

QUERIES = {f.__name__: f for f in (q_layout_places, q_sentence_contexts, q_shown_values)}
SQL = {"q_layout_places": LAYOUT_SQL, "q_sentence_contexts": CONTEXTS_SQL, "q_shown_values": SHOWN_SQL}
