"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities: e-mail and IP addresses, card and phone numbers. All other words
of a document, names and numbers of any form, are terms, and the corpus says how strongly a term reveals an entity: the pointwise mutual
information of the two, from the documents that have the entity, the term, and both. A term that gives away at
least DISCLOSURE of the entity's information, in at least LEAST_DOCS documents, is sanitised wherever it stands
in a document that has that entity: generalised, or removed if it occurs with that entity only.

Defined cases: null counts as empty and has no spans. Entities are what the patterns find in any row, and
rows that repeat an id count once each. A base span is kept whatever stands around it; terms never overlap
one. An empty table gives an empty result. All patterns take time in proportion to the text. Entities that stand in
the same documents are looked at together, as are terms, so that a long list in several copies makes no pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_bound, join_counted, map_batches, stage, utf8

KINDS = ("email", "ip", "card", "phone")
#: A term is sanitised if it gives away this share of an entity's information ...
DISCLOSURE = 0.9
#: ... and shares so many documents with it.
LEAST_DOCS = 2
HELD_TERMS = 300_000

# Possessive forms and checks of what stands before a match find the same matches as the plain patterns, without going back over long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¿¡"


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if _card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def term_of(word: str) -> str:
    """The form in which words are counted: without the marks around it, in lower case; empty for marks alone."""
    return word.strip(_MARKS).lower()


def terms_outside(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all terms of a text that overlap no covered stretch."""
    covered, at, reach = sorted(covered), 0, 0
    for m in _TERM.finditer(text):
        word = m[0]
        if term := term_of(word):
            a = m.start() + len(word) - len(word.lstrip(_MARKS))
            b = m.end() - len(word) + len(word.rstrip(_MARKS))
            while at < len(covered) and covered[at][0] < b:
                reach = max(reach, covered[at][1])
                at += 1
            if reach <= a:
                yield term, a, b


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct entities of a document: kind and text in lower case."""
    return list({f"{kind}:{text[a:b].lower()}" for kind, a, b in spans})


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _stretches(base: str) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for _, a, b in (s.split(":") for s in base.split(",") if s)]


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """Every term of the corpus and the number of documents that have it."""

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: dict[str, int] = {}
        memo: dict[bytes, str] = {}
        for batch in batches:
            for body in batch["_text"]:
                terms = set()
                for word in set(utf8(body).split()):
                    if (term := memo.get(word)) is None:
                        term = memo[word] = term_of(word.decode("utf-8", "surrogatepass"))
                    terms.add(term)
                for term in terms:
                    held[term] = held.get(term, 0) + 1
                if len(memo) > HELD_TERMS:
                    memo = {}
            if len(held) > HELD_TERMS:
                yield {"term": list(held), "n": list(held.values())}
                held = {}
        yield {"term": list(held), "n": list(held.values())}

    return map_batches(docs.select(F.col(text).alias("_text")), count, "term string, n bigint").filter("term != ''").groupBy("term").agg(F.sum("n").alias("term_docs"))


def _found(docs: DataFrame, text: str) -> DataFrame:
    """A row per document: counts and base spans, the entities, and the text where there are any."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out = {c: batch[c] for c in ("rid", "k1", "k2", "doc_id")}
            spans = [base_spans(t) for t in batch["_text"]]
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(s[0] == kind for s in found) for found in spans]
            out["base"] = [_joined(found) for found in spans]
            out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in out["base"]]
            out["entity"] = [entities(t, found) if found else [] for t, found in zip(batch["_text"], spans)]
            out["body"] = [t if found else None for t, found in zip(batch["_text"], spans)]
            yield out

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2"), "doc_id", F.col(text).alias("_text"))
    counts = "".join(f", n_{k} bigint" for k in KINDS)
    return stage(map_batches(slim, find, f"rid bigint, k1 bigint, k2 bigint, doc_id {id_type}{counts}, base string, base_sha256 string, entity array<string>, body string"), "found")


def _gives_away(both, entity_docs, term_docs, n_docs: int) -> Column:
    """Whether a term in so many documents reveals an entity that it shares ``both`` with."""
    information = F.log2(F.lit(float(n_docs)) / entity_docs)
    given_away = F.log2(both * F.lit(float(n_docs)) / (entity_docs * term_docs))
    return (information > 0) & (both >= LEAST_DOCS) & (given_away >= DISCLOSURE * information)


def _lists() -> list[Column]:
    """A digest of the set of documents that a row's group stands in."""
    return [F.bit_xor(f"r{i}").alias(f"l{i}") for i in (1, 2)]


def _classes(found: DataFrame, frequencies: DataFrame, n_docs: int, hot: float) -> tuple[DataFrame, DataFrame]:
    """(rid, entity class) and (rid, term, term class) of the documents with entities that others have as well.

    Entities in the same documents are one class, e1 and e2 with entity_docs; so are terms in the same of those
    documents and in as many of all, t1 and t2 with l1, l2, has and term_docs. Terms are left out that cannot reach
    the threshold: with ``has`` documents in which an entity may stand, no entity makes both ** 0.9 * n_docs ** 0.1
    exceed has ** 0.9 * n_docs ** 0.1, which has to be term_docs at least.
    """
    has = found.filter(F.size("entity") > 0).select("*", F.xxhash64("rid").alias("r1"), F.xxhash64(F.lit(1), "rid").alias("r2"))
    each = has.select("rid", "r1", "r2", F.explode("entity").alias("entity"))
    counts = stage(each.groupBy("entity").agg(F.count("*").alias("entity_docs"), *_lists()).filter(F.col("entity_docs") >= LEAST_DOCS), "entities")
    entity = join_counted(each.select("rid", "entity"), counts, ["entity"], "entity_docs", hot).select("rid", F.col("l1").alias("e1"), F.col("l2").alias("e2"), "entity_docs")
    entity = stage(entity.distinct(), "entity_classes")
    bodies = has.select("rid", "r1", "r2", "body", "base").join(entity.select("rid").distinct(), "rid")

    def sum_up(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: dict[str, tuple[int, int, int]] = {}

        def rows() -> dict[str, list]:
            n, r1, r2 = zip(*held.values()) if held else ((), (), ())
            return {"term": list(held), "n": list(n), "r1": list(r1), "r2": list(r2)}

        for batch in batches:
            for a, b, body, base in zip(*(batch[c] for c in ("r1", "r2", "body", "base"))):
                for term in {t for t, _, _ in terms_outside(body, _stretches(base))}:
                    n, x, y = held.get(term, (0, 0, 0))
                    held[term] = (n + 1, x ^ a, y ^ b)
                if len(held) > HELD_TERMS:
                    yield rows()
                    held = {}
        yield rows()

    def list_terms(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for rid, body, base in zip(*(batch[c] for c in ("rid", "body", "base"))):
                terms = list({t for t, _, _ in terms_outside(body, _stretches(base))})
                yield {"rid": [rid] * len(terms), "term": terms}

    summed = map_batches(bodies.select("r1", "r2", "body", "base"), sum_up, "term string, n bigint, r1 bigint, r2 bigint", rows=64)
    summed = summed.groupBy("term").agg(F.sum("n").alias("has"), *_lists()).filter(F.col("has") >= LEAST_DOCS).join(frequencies, "term")
    # A little slack, as this only leaves out what the exact test would; that one follows.
    may = (1 - DISCLOSURE) * F.log2(F.lit(float(n_docs))) + DISCLOSURE * F.log2(F.col("has").cast("double")) >= F.log2(F.col("term_docs").cast("double")) - 1e-6
    known = stage(summed.filter(may).select("term", "has", "term_docs", "l1", "l2", F.col("l1").alias("t1"), F.xxhash64("l2", "has", "term_docs").alias("t2")), "term_classes")
    terms = map_batches(bodies.select("rid", "body", "base"), list_terms, "rid bigint, term string", rows=64)
    return entity, stage(join_counted(terms, known, ["term"], "has", hot), "document_terms")


def _revealed(entity: DataFrame, terms: DataFrame, n_docs: int, hot: float) -> DataFrame:
    """(rid, t1, t2, removed): the term classes that give away an entity of the document.

    A class of terms in the documents of a class of entities is decided by its numbers. The others are met with the
    entities of their documents, class by class and without each entity class's largest document: a pair that counts
    shares another one too, and so a list of many entities with a document of each makes no pairs of all its classes.
    """
    by_class = terms.groupBy("t1", "t2").agg(*(F.first(c).alias(c) for c in ("l1", "l2", "has", "term_docs")))
    sizes = entity.groupBy("rid").agg(F.count("*").alias("classes"))
    of_entities = stage(entity.join(sizes, "rid").groupBy("e1", "e2").agg(F.first("entity_docs").alias("entity_docs"), F.max_by("rid", F.struct("classes", "rid")).alias("largest")), "entities_of_class")
    same = (F.col("l1") == F.col("e1")) & (F.col("l2") == F.col("e2")) & (F.col("has") == F.col("entity_docs"))
    gives = _gives_away(F.col("entity_docs"), F.col("entity_docs"), F.col("term_docs"), n_docs)
    equal = stage(by_class.join(of_entities, same).filter(gives).select("t1", "t2", "has", (F.col("has") >= F.col("term_docs")).alias("removed")), "equal_classes")
    each = stage(terms.select("rid", "t1", "t2", "has", "term_docs").distinct(), "document_classes")
    rest = each.join(equal.select("t1", "t2"), ["t1", "t2"], "left_anti")
    smaller = join_counted(entity.select("rid", "e1", "e2"), of_entities, ["e1", "e2"], "entity_docs", hot).filter("rid != largest").drop("largest")
    pair = ["e1", "e2", "t1", "t2"]
    met = smaller.join(rest, "rid").groupBy(*pair).agg(F.count("*").alias("some"), F.first("entity_docs").alias("entity_docs"), F.first("term_docs").alias("term_docs"))
    met = met.join(of_entities.select("e1", "e2", "largest"), ["e1", "e2"])
    there = rest.select(F.col("rid").alias("largest"), "t1", "t2", F.lit(1).alias("there"))
    both = F.col("some") + F.coalesce("there", F.lit(0))
    pairs = met.join(there, ["largest", "t1", "t2"], "left").withColumn("both", both).filter(_gives_away(F.col("both"), F.col("entity_docs"), F.col("term_docs"), n_docs))
    pairs = stage(pairs.select(*pair, (F.col("both") >= F.col("term_docs")).alias("removed")), "pairs")
    shared = rest.select("rid", "t1", "t2").join(pairs, ["t1", "t2"]).join(entity.select("rid", "e1", "e2"), ["rid", "e1", "e2"], "left_semi")
    by_equal = join_counted(each.select("rid", "t1", "t2"), equal, ["t1", "t2"], "has", hot)
    return by_equal.select("rid", "t1", "t2", "removed").unionByName(shared.groupBy("rid", "t1", "t2").agg(F.bool_or("removed").alias("removed")))


def _term_spans(found: DataFrame, revealed: DataFrame) -> DataFrame:
    """(rid, terms): all occurrences of each document's revealing terms, in order."""

    def locate(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            terms = []
            for body, base, some in zip(batch["body"], batch["base"], batch["some"]):
                removed = {t["term"]: t["removed"] for t in some}
                terms.append([{"start": a, "end": b, "removed": removed[t]} for t, a, b in terms_outside(body, _stretches(base)) if t in removed])
            yield {"rid": batch["rid"], "terms": terms}

    listed = revealed.groupBy("rid").agg(F.collect_list(F.struct("term", "removed")).alias("some"))
    return map_batches(found.select("rid", "body", "base").join(listed, "rid"), locate, "rid bigint, terms array<struct<start: int, `end`: int, removed: boolean>>", rows=256)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans (all), and the terms' spans with what becomes of them; one row per document."""
    found = _found(docs, text)
    n_docs = found.count()
    hot = hot_bound(n_docs)
    entity, terms = _classes(found, stage(document_frequencies(docs, text), "terms"), n_docs, hot)
    revealed = _revealed(entity, terms, n_docs, hot)
    listed = _term_spans(found, terms.select("rid", "term", "t1", "t2").join(revealed, ["rid", "t1", "t2"]))
    written = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"]))
    spans = F.array_join(F.filter(F.concat(F.array("base"), F.coalesce(written, F.array())), lambda s: s != ""), ",")
    return found.drop("entity", "body").join(listed, "rid", "left").withColumn("spans", spans)


def _clean(text: str | None, base: str, terms) -> str | None:
    if not text:
        return text
    spans = [(int(a), int(b), f"<{k.upper()}>") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    spans += [(t["start"], t["end"], "" if t["removed"] else "<TERM>") for t in (terms if terms is not None else ())]
    out, end = [], 0
    for a, b, mark in sorted(spans):
        if a >= end:
            out += (text[end:a], mark)
        end = max(end, b)
    return "".join((*out, text[end:]))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their entities replaced by their kind and revealing terms generalised or removed."""
    found = find_personal_data(docs, text).dropDuplicates(["k1", "k2"]).filter("spans != ''").select("k1", "k2", "base", "terms")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2"))
    clean = F.pandas_udf(lambda t, b, s: pd.Series([_clean(*x) for x in zip(t, b, s)]), "string", F.PandasUDFType.SCALAR)
    joined = keyed.join(found, ["k1", "k2"], "left")
    return joined.select(F.col("_doc").withField(text, clean(F.col("_text"), F.coalesce("base", F.lit("")), F.col("terms"))).alias("_doc")).select("_doc.*")
