import hashlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import block_naming, host_quality, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_text_counts_by_hand():
    assert host_quality.text_counts("a b c a b c\na b c a b c\n#x $") == (14, 15, 2, 1, 12)
    assert host_quality.text_counts(None) == host_quality.text_counts("\n \t") == (0, 0, 0, 0, 0)


def test_host_verdicts_shrink_small_hosts(make_docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(300)] + [(1000 + i, "bad", "spam") for i in range(300)] + [(2000 + i, good, "spam") for i in range(10)]
    rows += [(3000, "bad", "tiny"), (3001, good, "tiny"), (3002, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in host_quality.judge(make_docs(rows)).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] for i in range(300)) and not any(kept[2000 + i] for i in range(10))
    assert kept[3001] and not kept[3000] and kept[3002]


def test_host_verdict_is_relative_to_the_prior(make_docs):
    """A rate far below one half is rejected where other hosts hardly fail; where all hosts fail alike, none is."""
    good = " ".join(f"w{i}" for i in range(60))
    host = lambda name, n, bad, at: [(at + i, "bad" if i < bad else good, name) for i in range(n)]
    rows = [r for h in range(12) for r in host(f"h{h}", 100, 4, 1000 * h)] + host("odd", 100, 30, 50_000) + host("small", 4, 1, 60_000)
    verdicts = {r["source"]: r["host_kept"] for r in host_quality.judge(make_docs(rows)).collect()}
    assert [h for h, kept in verdicts.items() if not kept] == ["odd"]
    alike = [r for h in range(12) for r in host(f"h{h}", 100, 30, 1000 * h)]
    assert all(r["host_kept"] for r in host_quality.judge(make_docs(alike)).collect())


def test_verdicts_reach_a_host_without_ids(make_docs):
    """A third of all rows has one host, no id and one text."""
    good = " ".join(f"w{i}" for i in range(60))
    judged = host_quality.judge(make_docs([(None, good, "big")] * 300 + [(i, "bad", "big") for i in range(20)] + [(100 + i, good, f"h{i % 5}") for i in range(300)]))
    assert judged.count() == 620 and judged.select("source", "host_kept").distinct().count() == 6 and judged.filter("host_kept IS NULL").count() == 0


def test_rules_take_every_row(make_docs, edge_rows):
    assert host_quality.judge(make_docs(edge_rows)).count() == len(edge_rows)
    assert host_quality.judge(make_docs([])).count() == 0


def expected_groups(rows):
    texts = [(t or "").translate(LOWER) for _, t, _ in rows]
    best, size = {}, Counter(texts)
    for (i, _, _), t in zip(rows, texts):
        best[t] = max((x for x in (i, best.get(t)) if x is not None), default=None)
    return sorted(((i, best[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _, _), t in zip(rows, texts)), key=repr)


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (16, 3)])
def test_block_naming_equals_comparison_of_texts(make_docs, edge_rows, block, bits):
    rows = edge_rows + [(20, "lang " * 300, "c"), (21, "lang " * 301, "c"), (22, "LANG " * 300, "c")]
    found = block_naming.deduplicate(make_docs(rows), block_bytes=block, hash_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr) == expected_groups(rows)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in found})


def test_block_names_are_ranks_whatever_the_partitions(spark, make_docs, edge_rows):
    docs, found = make_docs(edge_rows), []
    for partitions in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(sorted((str(r["doc_id"]), r["text_sha256"], r["n_blocks"], r["name"]) for r in block_naming.identities(docs.repartition(partitions), block_bytes=16).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]
    blocks = {t[i : i + 16] for t in ((t or "").translate(LOWER).encode() for _, t, _ in edge_rows) for i in range(0, max(1, len(t)), 16)}
    assert {r[3] for r in found[0] if r[2] == 1} <= set(range(len(blocks)))


def test_unique_documents_keep_columns(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = block_naming.unique_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(t or "").translate(LOWER) for _, t, _ in edge_rows})
    assert block_naming.unique_documents(make_docs([])).count() == 0


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_gray_index_finds_all_neighbours():
    random = np.random.default_rng(1)
    centre = random.integers(0, 1 << 63, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 40, (3000, 4)).astype(np.uint64)
    prints = np.unique(centre ^ np.bitwise_xor.reduce(flips, axis=1))
    index = simhash.GrayIndex(prints, np.array([0]))
    who, where = index.search(prints, np.zeros(len(prints), dtype=np.int64))
    assert {*zip(who.tolist(), where.tolist())} == {*map(tuple, np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2).tolist())}


def test_near_duplicates_equal_brute_force(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, f"{i % 7} short {i // 7}", "d") for i in range(60)] + [(300 + i, f"alpha beta {i}", "d") for i in range(60)]
    found = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(found) == len(rows)
    prints = [int(r["fingerprint"], 16) for r in found]
    label = brute_components(prints)
    least = {}
    for r, c in zip(found, label):
        if r["doc_id"] is not None:
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert [r["component_id"] for r in found] == [least.get(c) for c in label]
    assert {r["fingerprint"] for r in found if r["doc_id"] in (4, 5, 6)} == {"0" * 16}


def test_links_join_a_long_chain(spark):
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << i))
    prints = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in chain], "fp long")
    roots = simhash.components(simhash.links(prints)).collect()
    assert len({r["root"] for r in roots}) == 1 and len(roots) == len(chain) - 1


@pytest.mark.parametrize("most", [1, 7, 1 << 16])
def test_large_runs_are_dealt_again(spark, most):
    """Fingerprints that agree on most bits, so that runs are cut by further blocks of bits: components as by brute force."""
    random = np.random.default_rng(5)
    flips = np.uint64(1) << random.integers(0, 64, (150, 3)).astype(np.uint64)
    prints = np.unique(np.uint64(0xF00DFACE12345678) ^ np.bitwise_xor.reduce(flips, axis=1))
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, most=most)).collect()}
    label, least = brute_components([int(x) for x in prints]), {}
    for x, c in zip(prints.view(np.int64).tolist(), label):
        least[c] = min(x, least.get(c, x))
    assert [roots.get(x, x) for x in prints.view(np.int64).tolist()] == [least[c] for c in label]


@pytest.mark.parametrize("hot", [1000, 2])
def test_components_of_a_star_and_a_common_print(spark, make_docs, monkeypatch, hot):
    """A centre with half of all links, a chain, and one text in half of the rows; hot keys are joined apart from the others."""
    monkeypatch.setattr(simhash, "hot_bound", lambda rows: hot)
    star = [(500, i) for i in range(501, 700)] + [(3, 500)] + [(i, i + 1) for i in range(1000, 1020)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert {roots[i] for i in range(501, 700)} == {3} and roots[500] == 3 and {roots[i] for i in range(1001, 1021)} == {1000}
    rows = [(i, None if i % 2 else f"alpha beta gamma delta {i}", "a") for i in range(40)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(rows)).collect()}
    label = brute_components([int(found[i]["fingerprint"], 16) for i in range(40)])
    assert all(found[i]["component_id"] == min(k for k in range(40) if label[k] == label[i]) for i in range(40))


def test_one_of_each_keeps_one_row(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = simhash.one_of_each(docs)
    near = simhash.near_duplicates(docs).collect()
    assert out.columns == docs.columns
    # Two components may have the same smallest id where ids repeat, so components are counted by brute force.
    assert out.count() == len(set(brute_components([int(r["fingerprint"], 16) for r in near])))
    assert simhash.near_duplicates(make_docs([])).count() == 0
