import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lattice_lm, pii, quality_classifier, repeated_passages, suffix_arrays


def test_classifier_learns_and_scores_everything(spark, make_docs, edge_rows):
    source = random.Random(1)
    clean = lambda: " ".join(source.choice("abcdefgh") + source.choice(["ing", "er", "tion"]) for _ in range(60))
    junk = lambda: " ".join(source.choice(["BUY!!", "NOW$$$", "x x x", "CLICK ###"]) for _ in range(40))
    rows = edge_rows + [(1000 + i, junk() if i % 3 == 0 else clean(), "s") for i in range(300)]
    labels = spark.createDataFrame([(1000 + i, int(i % 3 != 0), 0, 9.0) for i in range(300)] + [(None, 1, 0, 1.0), (5, None, None, None)], "doc_id long, quality int, toxic int, score double")
    docs = make_docs(rows)
    found = quality_classifier.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    held = [r for r in found if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert held and all(r["predicted"] == int((r["doc_id"] - 1000) % 3 != 0) for r in held)
    assert quality_classifier.accepted(docs, labels).columns == docs.columns
    assert {r["score"] for r in quality_classifier.classify(docs, labels.filter("false")).collect()} == {0.5}
    assert quality_classifier.classify(make_docs([]), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 900])
def test_sample_is_of_the_smallest_hashes(spark, monkeypatch, n):
    """Far more labels than 4,096 times the bound, and hash classes that are told apart by their last bits only."""
    rows = spark.range(n * 11).select(F.col("id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("_order"))
    close = spark.range(50).select((F.col("id") + 10**9).alias("doc_id"), F.col("id").alias("_order"))
    for table in (rows, rows.unionByName(close)):
        orders = sorted(r["_order"] for r in table.collect())
        for most in (0, 1, 2, 37, n, n * 11 + 50):
            assert sorted(r["_order"] for r in quality_classifier._bounded(table, most).collect()) == orders[:most]


def test_many_labels_still_give_a_sample(spark):
    orders = spark.range(20_000_000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("_order"))
    assert quality_classifier._bounded(orders, 100).count() == 100


def plain_leader(examples, passes):
    """Follow the regularised leader, one coordinate at a time."""
    alpha, beta, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for features, label in examples * passes:
        guess = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in features)))
        for i, v, w in [(i, v, weight(i)) for i, v in features]:
            step = (guess - label) * v
            z[i] += step - (math.sqrt(n[i] + step * step) - math.sqrt(n[i])) / alpha * w
            n[i] += step * step
    return {i: weight(i) for i in z}


def test_updates_and_scores_equal_a_plain_loop(spark, make_docs, monkeypatch):
    """One pass over ids in the order of their seeded hashes; an id with two texts and two labels counts once."""
    monkeypatch.setattr(quality_classifier, "PASSES", 1)
    texts = {i: f"word{i % 7} and Thing{i % 3} {'!!! BUY' if i % 4 == 0 else 'fine'}" for i in range(60)}
    docs = make_docs([(i, t, "s") for i, t in texts.items()] + [(3, "zzz another text", "s"), (None, "x", "s"), (99, None, "s")])
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(60)] + [(4, 1), (99, 0)], "doc_id long, quality int")
    known = {i: 1 if i == 4 else int(i % 4 != 0) for i in range(60)} | {99: 0}
    order = {r["doc_id"]: r["o"] for r in spark.createDataFrame([(i,) for i in known], "doc_id long").select("doc_id", F.xxhash64(F.lit(1), F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 4)).alias("o")).collect()}
    features = quality_classifier.Features()
    pairs = lambda text: list(zip(*(x.tolist() for x in features(text))))
    chosen = sorted((i for i in known if zlib.crc32(str(i).encode()) % 5), key=order.get)
    weights = plain_leader([(pairs(texts.get(i)), known[i]) for i in chosen], 1)
    for row in quality_classifier.classify(docs, labels).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id <> 3").collect():
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-sum(weights.get(i, 0.0) * v for i, v in pairs(row["text"])))), abs=1e-5)


def every_segmentation(lattice, text):
    if not text:
        return [0.0]
    out = []
    for n in range(1, len(text) + 1):
        if (p := lattice.pieces.get(text[:n])) is not None:
            out += [p + rest for rest in every_segmentation(lattice, text[n:])]
        elif n == 1:
            out += [sum(lattice.bytes[b] for b in text[0].encode()) + rest for rest in every_segmentation(lattice, text[1:])]
    return out


def test_lattice_sums_all_segmentations():
    pieces = {p: math.log(0.01 * (i + 1)) for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"])}
    lattice = lattice_lm.Lattice(pieces, [math.log(1e-4)] * 256)
    for word in ("a", "abab", "babab", "xaé", "b" * 9):
        assert lattice(word) == pytest.approx(math.log(sum(map(math.exp, every_segmentation(lattice, "▁" + word)))))


@pytest.mark.parametrize(("top", "bytes_"), [(1 << 17, 64), (3, 64), (1 << 17, 2)])
def test_scores_equal_plain_counts(make_docs, edge_rows, monkeypatch, top, bytes_):
    monkeypatch.setattr(lattice_lm, "TOP", top)
    monkeypatch.setattr(lattice_lm, "TOP_BYTES", bytes_)
    rows = edge_rows + [(100 + i, f"alpha beta gamma{i % 9} Delta {i}", "s") for i in range(80)] + [(None, "zeta zeta alone", "s")] * 60
    found = lattice_lm.score(make_docs(rows)).collect()
    assert len(found) == len(rows)
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(w for i, t, _ in rows if not out(i) for w in words(t)), sum(not out(i) for i, _, _ in rows)
    total = sum(counts.values()) + ends
    scale = total + 0.1 * (len(counts) + 2)
    wanted = []
    for i, t, _ in rows:
        base = sum(math.log10((counts[w] + 0.1) / scale) for w in words(t)) + math.log10((ends + 0.1) / scale)
        wanted.append((i or 0, out(i), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, total, round(base, 6)))
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == sorted(wanted)
    # The score: each piece counted by the vocabulary's own segmentation of the training words, then a plain sum over the lattice.
    path = lattice_lm.tokenizer_path("piece_bpe_32k.model")
    processor, pieces = lattice_lm._processor(path), Counter()
    for word, n in counts.items():
        for piece in processor.encode(word.decode()):
            pieces[piece] += n
    lattice, end = lattice_lm._lattice(path, pieces, ends)
    scores = Counter((i or 0, round((sum(map(lattice, (w.decode() for w in words(t)))) + end) / math.log(10), 4)) for i, t, _ in rows)
    assert Counter((r["doc_id"] or 0, round(r["score"], 4)) for r in found) == scores
    assert lattice_lm.score(make_docs([])).count() == 0


def test_words_of_held_out_rows_alone_are_frequent_too(spark):
    rated = spark.createDataFrame([("often", 0, 50, -1.0), ("learnt", 20, 20, -1.0), *((f"w{i}", 1, 1, -1.0) for i in range(20))], "word string, c long, n long, lp double")
    assert {r["word"] for r in lattice_lm._most_frequent(rated).collect()} == {"often", "learnt", *(f"w{i}" for i in range(20))}
    lattice_lm.TOP, top = 2, lattice_lm.TOP
    try:
        assert {r["word"] for r in lattice_lm._most_frequent(rated).collect()} == {"often", "learnt"}
    finally:
        lattice_lm.TOP = top


def test_suffix_arrays_equal_sorting(monkeypatch):
    """With buckets alone, in pairs and all in one group."""
    source = random.Random(3)
    for most, group in ((400, 4096), (1, 2), (2, 5), (1, 4096)):
        monkeypatch.setattr(suffix_arrays, "MOST_BUCKETS", most)
        monkeypatch.setattr(suffix_arrays, "GROUP", group)
        for _ in range(300):
            body = "".join(source.choice(source.choice(["ab", "abc", "a", "abcdefgh"])) for _ in range(source.randint(0, 60))).encode()
            text = np.append(np.frombuffer(body, np.uint8) + 1, 0).astype(np.uint8)
            whole = text.tobytes()
            suffixes = suffix_arrays.suffix_array(text)
            assert suffixes.tolist() == sorted(range(len(text)), key=lambda i: whole[i:])
            prefixes = suffix_arrays.permuted_common_prefixes(text, suffixes)
            for a, b in zip(suffixes.tolist(), suffixes[1:].tolist()):
                shared = 0
                while max(a, b) + shared < len(whole) and whole[a + shared] == whole[b + shared]:
                    shared += 1
                assert prefixes[b] == shared


def removed_by_hand(texts, width):
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        yield len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_arrays_of_many_names():
    """A string whose names are many at several levels, against sorting; and one of a single long run."""
    words = np.random.default_rng(7).integers(0, 900, 9000)
    for body in ("".join(f"{w:03d}," for w in words), "ab" * 9000, "a" * 9000):
        text = np.append(np.frombuffer(body.encode(), np.uint8) + 1, 0).astype(np.uint8)
        whole = text.tobytes()
        assert suffix_arrays.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: whole[i:])


@pytest.mark.parametrize(("most_bytes", "hot"), [(1_000_000, None), (300, None), (300, 1)])
def test_repeated_passages_equal_brute_force(make_docs, edge_rows, monkeypatch, most_bytes, hot):
    """Also where the pieces of most k-mers are cut again by longer ones, down to single strings, and where all keys are hot."""
    if hot:
        monkeypatch.setattr(repeated_passages, "hot_bound", lambda rows: hot)
    rows = list(edge_rows)
    source = random.Random(8)
    passage = " ".join(f"p{source.randint(0, 999)}" for _ in range(80))
    rows += [(60 + i, f"{i} start " + passage[: 250 + 13 * i] + f" end {i}", "s") for i in range(8)]
    rows += [(70, "again " + passage[100:400], "s")] * 30
    found = repeated_passages.remove_repeats(make_docs(rows), most_bytes=most_bytes).collect()
    got = sorted((r["n_bytes"], sum(r["removed"][1::2]) - sum(r["removed"][::2]), len(r["removed"]) // 2, hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
    assert got == sorted(removed_by_hand([(t or "").encode() for _, t, _ in rows], 200))
    assert repeated_passages.repeat_digests(make_docs([])).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                yield kind, *m.span()


def test_base_spans_equal_plain_patterns():
    source = random.Random(9)
    parts = ["1", "2", "0", "255", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "x@y.z", "4111111111111111", "é", "1.2.3.4", "+1 555 123 4567", ".."]
    for _ in range(5000):
        text = "".join(source.choice(parts) for _ in range(source.randint(1, 25)))
        assert pii.base_spans(text) == list(plain_spans(text))
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == []


def test_terms_of_a_long_list_take_linear_time():
    text = "\n".join(f"Name{i} Surname{i} <user{i}@mail.example.org> +1 555 {i:07d}" for i in range(60_000))
    began = time.time()
    spans = pii.base_spans(text)
    terms = list(pii.terms_outside(text, [(a, b) for _, a, b in spans]))
    assert len(spans) == 120_000 and len(terms) == 120_000 and len(text) > 3_000_000 and time.time() - began < 30


def test_terms_of_any_form(make_docs):
    assert [t for t, _, _ in pii.terms_outside("(Jean-Luc) o'Brien, jdoe42 Li #42! -- x@y.z", [(37, 42)])] == ["jean-luc", "o'brien", "jdoe42", "li", "42"]


def test_revealing_terms_are_sanitised(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, f"the report of Zebulon is with anna{i // 10}@corp.example.com now", "s") for i in range(4)] + [(200 + i, f"the report of today is with us now {i}", "s") for i in range(400)]
    docs = make_docs(rows)
    found = pii.find_personal_data(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[9]["n_email"], by_id[9]["n_ip"], by_id[9]["n_card"], by_id[9]["n_phone"]) == (1, 1, 1, 1)
    spans = dict.fromkeys(by_id[100]["spans"].split(","))
    text = rows[len(edge_rows)][1]
    assert {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans) if k == "term"} == {"Zebulon"}
    assert all(not by_id[200 + i]["spans"] for i in range(400))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[100] == "the report of  is with <EMAIL> now" and clean[200] == rows[len(edge_rows) + 4][1]
    assert pii.sanitised(docs).columns == docs.columns
    assert pii.find_personal_data(make_docs([])).count() == 0


def test_revealing_terms_are_sanitised_in_the_whole_document(make_docs, monkeypatch):
    """A name in the heading and an address in the footer of a long text, and the name again between: against counts by plain Python."""
    middle = " ".join(f"the common words of part{chr(97 + i % 26)}" for i in range(200))
    rows = [(i, f"Zebulon {middle} says zebulon, and {middle} mail anna@corp.example.com", "s") for i in range(3)]
    rows += [(10 + i, f"{middle} mail hot@corp.example.com Quillon{'' if i else ' alone'}", "s") for i in range(12)]
    rows += [(100 + i, f"{middle} mail us", "s") for i in range(100)]
    words = {i: {pii.term_of(w) for w in t.split() if "@" not in w} - {""} for i, t, _ in rows}
    for hot in (1000, 2):
        monkeypatch.setattr(pii, "hot_bound", lambda rows, hot=hot: hot)
        docs = make_docs(rows)
        for r in pii.find_personal_data(docs).collect():
            body = next(t for i, t, _ in rows if i == r["doc_id"])
            group = [i for i, t, _ in rows if any(e in t and e in body for e in ("anna@", "hot@"))]
            wanted = set()
            for term in words[r["doc_id"]] if group else ():
                both, having = sum(term in words[i] for i in group), sum(term in w for w in words.values())
                if both >= 2 and math.log2(both * len(rows) / (len(group) * having)) >= 0.9 * math.log2(len(rows) / len(group)):
                    wanted.add(term)
            spans = [body[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"]
            assert set(spans) == wanted and len(spans) == sum(pii.term_of(w) in wanted for w in body.split())
        clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
        assert "zebulon" not in clean[0].lower() and "Quillon" not in clean[12] and clean[100] == rows[15][1]


def plain_terms(rows):
    """By counts of all pairs: {row: {(term, removed)}}."""
    words, known = [], []
    for _, text, _ in rows:
        spans = pii.base_spans(text)
        words.append({t for t, _, _ in pii.terms_outside(text or "", [(a, b) for _, a, b in spans])})
        known.append(set(pii.entities(text or "", spans)))
    n, out = len(rows), [{} for _ in rows]
    term_docs, entity_docs, both = Counter(t for w in words for t in w), Counter(e for k in known for e in k), Counter((e, t) for w, k in zip(words, known) for e in k for t in w)
    for (e, t), b in both.items():
        information = math.log2(n / entity_docs[e])
        if b >= 2 and entity_docs[e] >= 2 and information > 0 and math.log2(b * n / (entity_docs[e] * term_docs[t])) >= 0.9 * information:
            for found, w, k in zip(out, words, known):
                if t in w and e in k:
                    found[t] = found.get(t, False) or b >= term_docs[t]
    return [set(found.items()) for found in out]


@pytest.mark.parametrize("hot", [1000, 2])
def test_term_spans_equal_counts_of_all_pairs(make_docs, monkeypatch, hot):
    """Directories in versions with a page of each person, near copies, and common terms."""
    monkeypatch.setattr(pii, "hot_bound", lambda rows: hot)
    source = random.Random(4)
    mail = lambda k: f"user{k}@mail.example.org"
    lines = [f"Name{k} Town{k % 7} {mail(k)} +1 555 010 {k:04d}" for k in range(30)]
    texts = ["\n".join(lines), "\n".join(lines), "\n".join(lines[:25] + ["Name99 extra"])]
    texts += [f"Page of Name{k} in Town{k % 7}: hobby{k} {mail(k)} hobby{k}" for k in range(0, 30, 2)]
    base = [f"w{source.randrange(90)}" for _ in range(60)]
    texts += [" ".join([w for w in base if source.random() > 0.05] + [mail(source.choice([1, 2, 200])), f"odd{source.randrange(6)}"]) for _ in range(25)]
    texts += [" ".join(f"w{source.randrange(120)}" for _ in range(40)) + source.choice([" Town3", " hobby4", "", " odd2 Name5"]) for _ in range(120)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    wanted = plain_terms(rows)
    found = {r["doc_id"]: r for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert len(found) == len(rows) and sum(map(len, wanted)) > 100 and {True, False} == {x for w in wanted for _, x in w}
    for i, text, _ in rows:
        got = {(pii.term_of(text[t["start"] : t["end"]]), t["removed"]) for t in found[i]["terms"] or ()}
        assert got == wanted[i], i


def test_long_lists_make_no_pairs(make_docs):
    """Two copies of a megabyte of addresses, and a page of each tenth person."""
    text = "\n".join(f"Name{i} Surname{i} <user{i}@mail.example.org> +1 555 {i:07d}" for i in range(18_000))
    rows = [(1, text, "s"), (2, text, "s")] + [(10 + i, f"Name{i} is user{i}@mail.example.org", "s") for i in range(0, 18_000, 10)]
    rows += [(100_000 + i, "nothing of the kind", "s") for i in range(2000)]
    began = time.time()
    found = {r["doc_id"]: r["n_terms"] for r in pii.find_personal_data(make_docs(rows)).selectExpr("doc_id", "coalesce(size(terms), 0) AS n_terms").collect()}
    assert time.time() - began < 90
    assert found[1] == found[2] == 36_000 and all(found[10 + i] == 1 for i in range(0, 18_000, 10))
