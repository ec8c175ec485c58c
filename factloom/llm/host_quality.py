"""Quality rules with host verdicts.

Each document gets rule counts of its own. Failures are then counted by host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and the verdict on the
host goes back to its documents. A host is rejected if its rate exceeds the prior's by HOST_FACTOR even when
HOST_CERTAINTY standard deviations of its posterior are taken off, so neither a few documents nor chance are
enough, and a corpus whose hosts are alike loses none.

Defined cases: a null or empty text has no words, so it fails the word rule. A document without a host
(null source) is judged by its own rules only. Repeated rows count once each. An empty table gives an empty
result. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host is rejected if its posterior rate, less so many standard deviations, is above so many times the prior's.
HOST_FACTOR, HOST_CERTAINTY = 1.5, 2.0
#: The prior counts as at least and at most this many documents: below, it would say nothing; above, no host could stand out.
PRIOR_STRENGTH = (4.0, 1000.0)
#: A host's verdict is kept this many times, so that the documents of one large host meet it in as many tasks.
SALTS = 64


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words in repeated windows of three words."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    chars = sum(len(w) for w in words) if text.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(text.count(s) for s in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated, upto = 0, 0
    if len(seen) < len(windows):
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, upto)
                upto = at + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """One row of counts per document, with the columns of ``keep``."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    slim = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            counts = [text_counts(t) for t in batch["_text"]]
            yield {k: batch[k] for k in keep} | {n: [c[i] for c in counts] for i, n in enumerate(names)}

    return map_batches(slim, count, kept + "".join(f", {n} bigint" for n in names))


def base_failure() -> F.Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words)


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", factor: float = HOST_FACTOR, certainty: float = HOST_CERTAINTY) -> DataFrame:
    """One row per host: documents, failures, the failure rate shrunk by the beta prior, and the verdict."""
    hosts = stage(judged.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.count_if(failed).alias("host_failures")), "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    moments = hosts.agg(F.sum("host_failures"), F.sum("host_docs"), F.avg(rate), F.var_samp(rate), F.avg(1 / F.col("host_docs"))).first()
    failures, total, mean, variance, noise = (float(x or 0) for x in moments)
    mean = mean if 0 < mean < 1 else (failures + 1) / (total + 2)
    # The spread of the rates beyond what chance gives hosts of these sizes is the prior's own.
    spread = variance - mean * (1 - mean) * noise
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else PRIOR_STRENGTH[1]
    strength = min(max(strength, PRIOR_STRENGTH[0]), PRIOR_STRENGTH[1])
    weight = F.col("host_docs") + F.lit(strength)
    shrunk = (F.col("host_failures") + F.lit(mean * strength)) / weight
    deviation = F.sqrt(F.col("host_failure_rate") * (1 - F.col("host_failure_rate")) / (weight + 1))
    return hosts.withColumn("host_failure_rate", shrunk).withColumn("host_kept", F.col("host_failure_rate") - certainty * deviation <= factor * mean)


def judge(docs: DataFrame, factor: float = HOST_FACTOR, certainty: float = HOST_CERTAINTY) -> DataFrame:
    """doc_id, source, the counts, base_failed, the host's shrunk failure rate and verdict (null without a host), and kept."""
    judged = stage(document_counts(docs).withColumn("base_failed", base_failure()), "counts")
    verdicts = host_verdicts(judged, factor=factor, certainty=certainty).select(F.col("source").alias("_host"), "host_failure_rate", "host_kept").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # By place in the written counts, as ids and counts may be alike in any number of rows.
    salted = judged.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(verdicts, (salted["source"] == verdicts["_host"]) & (salted["_salt"] == verdicts["_salt"]), "left")
    return joined.select(*judged.columns, "host_failure_rate", "host_kept", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN dups USING (rid) LEFT JOIN repeated USING (rid)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT avg(k / n) AS m0, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS noise, sum(k) AS ks, sum(n) AS ns FROM hosts
), mean AS (
  SELECT *, CASE WHEN m0 > 0 AND m0 < 1 THEN m0 ELSE (ks + 1) / (ns + 2) END AS m FROM moments
), prior AS (
  SELECT m, least(greatest(CASE WHEN v - m * (1 - m) * noise > 0 THEN m * (1 - m) / (v - m * (1 - m) * noise) - 1
    ELSE {PRIOR_STRENGTH[1]} END, {PRIOR_STRENGTH[0]}), {PRIOR_STRENGTH[1]}) AS s FROM mean
), verdicts AS (
  SELECT source, r AS host_failure_rate, r - {HOST_CERTAINTY} * sqrt(r * (1 - r) / (n + s + 1)) <= {HOST_FACTOR} * m AS host_kept
  FROM (SELECT source, n, m, s, (k + m * s) / (n + s) AS r FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_failure_rate, 6) AS host_failure_rate, host_kept,
  NOT base_failed AND coalesce(host_kept, true) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""
