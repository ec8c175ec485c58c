import hashlib
import math
import random
import re

import numpy as np
import pytest

from factloom.llm import block_anchors, lexical_search, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, label int, code string, error double, sums long, v int, _n int"


# Vector codes


def plain_codes(rows):
    """By the definition, entry by entry: {(vec_id, code, error, label_error)} and the digest of the codebooks."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in kept) // 8
    parts = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[parts[k][p] for k in first] for p in range(8)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            members = [[] for _ in books[p]]
            for part in parts:
                members[assign(p, part[p])[1]].append(part[p])
            books[p] = [[sum(c) // len(some) for c in zip(*some)] if some else old for some, old in zip(members, books[p])]
    out, by_label = [], {}
    for (i, _, label), part in zip(kept, parts):
        found = [assign(p, part[p]) for p in range(8)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    flat = ",".join(str(c) for book in books for entry in book for c in entry)
    return sorted(((i, code, error, by_label[label]) for i, code, error, label in out), key=repr), hashlib.sha256(flat.encode()).hexdigest()


def some_vectors(n, width=16, spread=1.0, seed=3):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(rng.randrange(4), spread))) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(n)]  # one vector in half of the rows
    rows += [(3, rows[5][1], 2), (3, rows[5][1], 2), (None, rows[7][1], 2)]
    return rows + [(2000, None, 1), (2001, [*rows[0][1][:-1], None], 1), (2002, [float("nan")] * width, None), (2003, [float("-inf")] * width, 1)]


@pytest.mark.parametrize(("n", "spread", "scale"), [(60, 1.0, 1.0), (60, 0.0, 1.0), (5, 1.0, 1.0), (30, 1.0, 3e4)])
def test_codes_equal_plain_rounds(spark, n, spread, scale):
    """Spread 0 gives equal entries (ties); a great scale needs more than 64 bits on the way."""
    rows = [(i, v and [x if x is None else float(np.float32(x * scale)) for x in v], label) for i, v, label in some_vectors(n, spread=spread)]
    vectors = spark.createDataFrame([(*r, "x", 0.5, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    found = vector_codes.compress(vectors).collect()
    want, digest = plain_codes(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=repr) == want
    assert {r["codebooks_sha256"] for r in found} == {digest}


def test_search_finds_the_nearest_entry_from_any_start():
    rng = np.random.default_rng(5)
    for _ in range(50):
        points, entries = rng.integers(-9, 9, (40, 3)), rng.integers(-9, 9, (16, 3))
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        index, least = vector_codes.nearest(points, entries, rng.integers(0, 16, 40))
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()


def test_vectors_of_no_or_odd_length(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).collect() == []
    assert vector_codes.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(1, [], 1), (2, [0.5] * 5, 1), (3, [0.5] * 9, None)]
    found = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame([(*r, "x", 0.5, 1, 2, 3) for r in rows], VECTORS)).collect()}
    assert {i: r["error"] for i, r in found.items()} == {1: 0, 2: 0, 3: 0}
    assert vector_codes.compress(spark.createDataFrame([(1, [], 1, "x", 0.5, 1, 2, 3)], VECTORS)).first()["code"] == "00" * 8


# Repeated word sequences


def plain_repeats(rows):
    """By the definition: {(doc_id, n_words, n_removed, digest of the kept words)}."""
    split = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    first = {}
    key = lambda i, at: (i is None, i or 0, at)
    for i, words in split:
        for at in range(len(words) - 19):
            h = tuple(words[at : at + 20])
            first[h] = min(first.get(h, key(i, at)), key(i, at))
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - 19):
            if first[tuple(words[at : at + 20])] < key(i, at):
                gone.update(range(at, at + 20))
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def copies(seed=11):
    """Texts with shared stretches of 15 to 60 words at any offset, a passage of a third of all, and near and exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    shared = [[word() for _ in range(n)] for n in (15, 19, 20, 21, 29, 40, 60)]
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        if i % 3 == 0:
            words += shared[-1]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words), "a"))
    near = rows[7][1].split() + [word() for _ in range(80)]
    rows += [(200 + i, " ".join([*near[: 10 + i], "x", *near[10 + i :]]), "b") for i in range(40)]
    rows += [(300 + i, " ".join(near), "b") for i in range(40)] + [(400, "same " * 300, "c"), (401, "same " * 25, "c"), (402, "a b " * 90, "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk", "bucket"), [(500_000, 2_000_000), (200, 500)])
def test_repeats_equal_plain_windows(make_docs, edge_rows, monkeypatch, chunk, bucket):
    """In one chunk and bucket, and in many of each."""
    rows = copies() + edge_rows
    docs = make_docs(rows).repartition(5)
    monkeypatch.setattr(block_anchors, "BUCKET_KEYS", bucket)
    found = block_anchors.repeat_digests(docs, chunk_words=chunk).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == plain_repeats(rows)


def test_removed_runs_are_maximal_and_leave_the_kept_words(make_docs):
    rows = copies(12)
    texts = {i: WORD.findall(t) for i, t, _ in rows}
    removed = 0
    for r in block_anchors.without_repeats(make_docs(rows)).collect():
        words = texts[r["doc_id"]]
        gone = {k for run in r["removed"] for k in range(run["first"], run["end"])}
        assert r["kept_text"] == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert all(run["end"] - run["first"] >= 20 for run in r["removed"]) and all(a["end"] < b["first"] for a, b in zip(r["removed"], r["removed"][1:]))
        removed += len(r["removed"])
    assert removed > 50


def test_no_documents_no_repeats(make_docs):
    assert block_anchors.repeat_digests(make_docs([])).count() == 0
    assert {r["n_removed"] for r in block_anchors.repeat_digests(make_docs([(1, "a b", "x"), (2, None, None)])).collect()} == {0}


def test_rolling_hashes_are_those_of_the_same_words():
    words = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    twice = np.concatenate((words, words[3:50]))
    h = block_anchors.rolling(twice, 20, block_anchors._BASES[0])
    assert len(h) == len(twice) - 19 and (h[3:31] == h[100:128]).all() and len(set(h.tolist())) == len(h) - 28


# Ranked search


def plain_ranking(items, rows):
    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t, _ in rows]
    docs = [(i, terms) for i, terms in docs if terms]
    n, total = len(docs), sum(len(t) for _, t in docs)
    counted = [(i, len(t), {x: t.count(x) for x in set(t)}) for i, t in docs]
    df = {}
    for _, _, tf in counted:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        asked = [t for t in set(TERM.findall((text or "").translate(LOWER))) if t in df]
        scored = []
        for i, length, tf in counted:
            m = 10 + (90 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            scored += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:10], 1)]
    return sorted(out, key=repr)


def ranked_rows(edge_rows):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(200)] + ["Ümlaut", "naïve", "x1y", "日本語"]
    rows = [(i, rng.choice([" ", ", ", "-", "_"]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 80))), "a") for i in range(400)]
    rows += [(1000 + i, rows[9][1], "b") for i in range(30)]  # ties
    items = [(k, rng.choice(rows)[1][: rng.randrange(20, 300)]) for k in range(25)] + [(50, None), (51, ""), (52, "unheard-of"), (53, "T1 t1 T1"), (53, "T1 t1 T1"), (53, "t2"), (None, "t3"), (54, "don't 日本語")]
    return items, rows + edge_rows


@pytest.mark.parametrize(("block", "held", "group"), [(256, 32, 4 << 20), (7, 3, 1500)])
def test_ranking_equals_plain_scores(spark, make_docs, edge_rows, monkeypatch, block, held, group):
    items, rows = ranked_rows(edge_rows)
    monkeypatch.setattr(lexical_search, "HELD_BLOCKS", held)
    found = lexical_search.search(spark.createDataFrame(items, "item_id long, text string"), make_docs(rows).repartition(3), group_bytes=group, block_docs=block).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=repr) == plain_ranking(items, rows)


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """One block has the documents of the term; others have it once in long documents."""
    scored = []
    make = lambda tf, size: lexical_search._Block({"ids": list(range(10)), "sizes": np.full(10, size).tobytes(), "at": np.arange(11).tobytes(), "terms": np.zeros(10, np.int32).tobytes(), "counts": np.full(10, tf).tobytes()}, 100, 10_000)
    blocks = [make(1, 1000), make(50, 100), make(1, 2000)]
    asked = lexical_search._Items([[0]], np.array([700]))
    monkeypatch.setattr(lexical_search._Block, "scores", lambda self, w, f=lexical_search._Block.scores: scored.append(self) or f(self, w))
    best, floor = lexical_search.best_of(blocks, asked, {}, [1], whole=True)
    assert scored == [blocks[1]] and len(best[0]) == 10 and floor[0] == best[0][-1][0]
    assert [asked.bounds(b)[0] for b in blocks] == [max(asked.scores(b, 0)) for b in blocks]


def test_nothing_to_search(spark, make_docs, edge_rows):
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_search.search(some, make_docs([])).collect() == []
    assert lexical_search.search(some.limit(0), make_docs(edge_rows)).collect() == []
    assert lexical_search.search(some, make_docs([(1, None, "a"), (2, "...", "a")])).collect() == []
