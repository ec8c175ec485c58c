"""Each stage of the pipeline against a plain version of it, and all of them together."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import quality_classifier, simhash, source_mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLEAN = ("river", "stone", "garden", "window", "letter", "morning", "village", "music")


@pytest.fixture(scope="module")
def corpus(spark, make_docs, edge_rows, tmp_path_factory):
    source = random.Random(11)
    rows, labels = list(edge_rows), []
    for i in range(240):
        junk = i % 4 == 0
        text = " ".join("BUY!! NOW$$$" if junk else source.choice(CLEAN) for _ in range(source.randint(30, 120)))
        rows.append((1000 + i, text, source.choice(["hot", "hot", "b", None])))
        labels.append((1000 + i, int(not junk), 0))
        if i % 10 == 1:
            rows += [(2000 + i, text.upper(), "b"), (3000 + i, text + " Epilogue", "hot")]
    folder = tmp_path_factory.mktemp("corpus")
    make_docs(rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def rows_of(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def key(row):
    return tuple((x is not None, x or 0) for x in row[:1]) + tuple((x is not None, x or "") for x in row[1:])


def test_stages_equal_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "source_mix", "bpe"]

    weights, features = quality_classifier.train(docs, labels), quality_classifier.Features()
    score = lambda t: 1 / (1 + np.exp(-float(np.dot(weights[(f := features(t))[0]], f[1]))))
    kept = corpus_pipeline.classify_quality(spark, docs, corpus).cache()
    assert sorted(rows_of(kept), key=key) == sorted((r for r in rows_of(docs) if score(r[1]) >= quality_classifier.THRESHOLD), key=key)
    assert not any("BUY" in (t or "") for _, t, _ in rows_of(kept)) and any("river" in (t or "") for _, t, _ in rows_of(kept))

    unique = corpus_pipeline.drop_copies(spark, kept, corpus).cache()
    best = {}
    for row in rows_of(kept):
        text = (row[1] or "").translate(LOWER)
        if text not in best or (row[0] is not None and (best[text] is None or row[0] > best[text])):
            best[text] = row[0]
    assert Counter(((r[1] or "").translate(LOWER), r[0]) for r in rows_of(unique)) == Counter(best.items())

    apart = corpus_pipeline.drop_near_copies(spark, unique, corpus).cache()
    rows = rows_of(unique)
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    assert sorted((r[0] or 0) for r in rows_of(apart)) == sorted((x or 0) for x in least.values())

    mixed = corpus_pipeline.mix_sources(spark, apart, corpus).cache()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows_of(apart):
        sizes[s] += len((t or "").split())
    for _, t, s in rows_of(mixed):
        taken[s] += len((t or "").split())
    sources = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    for s, target in zip(sources, source_mix.targets([sizes[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))])):
        # The document at the cut comes whole or not at all, whichever is nearer.
        assert abs(taken[s] - target) <= 1 + max((len((t or "").split()) for _, t, x in rows_of(apart) if x == s), default=0) / 2
    assert {r[:2] for r in rows_of(mixed)} <= {r[:2] for r in rows_of(apart)}
    assert max(Counter((i, t) for i, t, _ in rows_of(mixed)).values()) <= 2 * max(Counter(r[:2] for r in rows_of(apart)).values())
    assert mixed.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in mixed.collect())

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, t, _ in rows_of(mixed):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        wanted[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    encoded = corpus_pipeline.encode(spark, mixed, corpus).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in encoded) == wanted
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, corpus).collect()) == wanted


def test_empty_tables_pass_through(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
