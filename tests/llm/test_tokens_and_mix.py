import hashlib
import random
import time
import zlib
from collections import Counter
from math import ceil

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from factloom.llm import bpe_reuse, encoding, source_mix, token_files
from factloom.llm.common import stage

PARTS = ["the", "a", "  ", "\n", "\n\n", " x", "don't", "'s", "it's,", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "é", " ", "日本", "😀", "12", "3.5", "...", "!!", "\t", "Word ", " \n ", ",", ".", "é,", "_,", "²,", "́", "Σ", "İ", "×,", "A.B", "'ll!"]


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def invented(seed, n, most=25):
    source = random.Random(seed)
    return ["".join(source.choice(PARTS) for _ in range(source.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_units_encode_like_whole_texts(monkeypatch, name, spaces):
    monkeypatch.setattr(encoding, "MEMO_SIZE", {True: 200, False: 200})
    plain, encoder = tokenizer(name), encoding.UnitEncoder(public_tokenizers.path(name), spaces)
    texts = invented(1, 4000)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_joins_are_repaired_at_any_cut():
    plain, encoder, source = tokenizer("byte_bpe_50k.json"), bpe_reuse.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    for text in invented(3, 3000):
        data = text.encode()
        ends = np.cumsum([len(c.encode()) for c in text]).tolist()
        places = [0, *sorted(source.sample(ends[:-1], min(len(ends) - 1, source.randint(0, 5)))), len(data)] if len(ends) > 1 else [0, len(data)]
        pieces = [(a, b, encoder.encode([data[a:b]])[0]) for a, b in zip(places, places[1:])]
        assert encoder.join(data, pieces).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_joins_without_spaces_take_linear_time():
    """Long texts in which the tokenizer's first step finds no place to cut: characters of three bytes, letters, one letter, and runs of spaces."""
    plain, encoder, source = tokenizer("byte_bpe_50k.json"), bpe_reuse.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(12)
    for letters, n in (("日本語中国人民大学生活動物", 100_000), ("etaoinshr", 100_000), ("a", 20_000), (" ", 20_000), ("日🙂", 50_000)):
        text = "".join(source.choice(letters) for _ in range(n))
        data = text.encode()
        places = bpe_reuse.cuts(data) if n > 20_000 else [*range(0, n, 700), n]
        pieces = [(a, b, encoder.encode([data[a:b]])[0]) for a, b in zip(places, places[1:])]
        began = time.time()
        joined = encoder.join(data, pieces)
        assert time.time() - began < 10 and len(pieces) > 25
        assert joined.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [None, 1])
def test_two_long_texts_without_spaces(make_docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(bpe_reuse, "hot_bound", lambda rows: hot)
    source = random.Random(13)
    text = "".join(source.choice("日本語中国人民大学生活動物") for _ in range(300_000))
    rows = [(1, text, "a"), (2, text, "b"), (3, "前書き" + text + "end", None)]
    plain = tokenizer("byte_bpe_50k.json")
    found = {r["doc_id"]: r for r in bpe_reuse.token_digests(make_docs(rows)).collect()}
    for i, t, _ in rows:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_cuts_follow_content():
    source = random.Random(4)
    body = " ".join(f"w{source.randint(0, 10**6)}é" for _ in range(3000)).encode()

    def chunks(data):
        places = bpe_reuse.cuts(data)
        return [data[a:b] for a, b in zip(places, places[1:])]

    assert b"".join(chunks(body)) == body
    assert len({*chunks(body)} & {*chunks(b"another start " + body)}) > 0.8 * len(chunks(body))


def test_bpe_round_trip(make_docs, edge_rows):
    shared = " ".join(f"shared{i} words go here" for i in range(400))
    rows = edge_rows + [(50, "intro " + shared, "a"), (51, "other beginning, " + shared + " end", "b"), (52, shared, "b")]
    found = {(r["doc_id"], r["ids_sha256"]): r for r in bpe_reuse.token_digests(make_docs(rows)).collect()}
    plain = tokenizer("byte_bpe_50k.json")
    wanted = {}
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        wanted[i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] = (len(ids), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {k: (r["n_tokens"], r["decoded_sha256"]) for k, r in found.items()} == wanted
    assert bpe_reuse.token_digests(make_docs(rows)).count() == len(rows)
    assert bpe_reuse.token_digests(make_docs([])).count() == 0


def test_repeated_rows_are_encoded_once_and_all_given_out(make_docs, edge_rows, monkeypatch):
    rows = edge_rows * 3 + [(60, "the same text again, " * 90, "a")] * (bpe_reuse.ROWS + 44)
    plain = tokenizer("byte_bpe_50k.json")
    sizes = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in bpe_reuse.token_digests(make_docs(rows)).collect()) == sizes

    staged = []
    monkeypatch.setattr(bpe_reuse, "stage", lambda df, name: staged.append((name, stage(df, name))) or staged[-1][1])
    assert bpe_reuse.token_digests(make_docs([(1, edge_rows[0][1], "a")] * 5)).count() == 5
    assert dict(staged)["shared"].count() == 0


def test_blocks_round_trip():
    source = np.random.default_rng(5)
    for high in (1, 2, 100, 50_000, 1 << 17, 1 << 32):
        for n in (1, 7, 4096):
            ids = source.integers(0, high, n, dtype=np.uint64).astype("<u4")
            ids[:: max(1, n // 5)] = min(high * 30, (1 << 32) - 1)
            assert np.array_equal(token_files.unpack(token_files.pack(ids)), ids)
    blocks, at = token_files.pack_blocks(np.arange(10_000, dtype="<u4"))
    assert np.array_equal(token_files.unpack(memoryview(blocks)[at[1] : at[2]]), np.arange(4096, 8192))


def test_token_files_round_trip(make_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # Spark's xxhash64 is seeded with 42, which is also its hash of null.
    hashed = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    found = sorted(token_files.token_digests(make_docs(edge_rows)).collect(), key=lambda r: r["start"])
    plain, start, wanted = tokenizer("word_bpe_49k.json"), 0, []
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == wanted
    assert token_files.token_digests(make_docs([])).count() == 0


def test_targets_reshare_what_exceeds_the_cap():
    assert source_mix.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert source_mix.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert source_mix.targets([], []) == []


def test_splitting_tree_keeps_quotas():
    quotas = [0, 5, 8192, 100]
    split = source_mix.split_quotas(quotas, 16, 3)
    assert split.sum(axis=0).tolist() == quotas and (split >= 0).all()
    rows = split.sum(axis=1)
    assert rows.max() - rows.min() <= 16


def test_mix_meets_targets_to_the_word(make_docs, edge_rows):
    source = random.Random(6)
    rows = edge_rows + [(1000 + i, " ".join("w" for _ in range(source.randint(0, 90))), source.choice(["hot", "hot", "b", "z", None])) for i in range(600)]
    docs = make_docs(rows)
    found = source_mix.mix(docs).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(r["size"] for r in found if r["source"] == s) for s in names]
    for name, target, size in zip(names, source_mix.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), sizes):
        mine = [r for r in found if r["source"] == name]
        assert {r["source_size"] for r in mine} == {size} and all(r["target"] == pytest.approx(target) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 1
    again = sorted((r["doc_id"] or 0, r["taken"]) for r in source_mix.mix(docs).collect())
    assert again == sorted((r["doc_id"] or 0, r["taken"]) for r in found)
    assert source_mix.mix(make_docs([])).count() == 0


def plain_mix(rows, shards, seed):
    """The mix by plain loops: (source, pass, shard, doc_id, text, words) of all draws."""
    hashed = lambda i, t: xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)))
    by_source = {}
    for i, t, s in rows:
        by_source.setdefault(s, []).append((hashed(i, t), i, t, len(t.split())))
    names = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    sizes = [sum(r[3] for r in by_source[s]) for s in names]
    targets = [min(round(t), 2 * n) for t, n in zip(source_mix.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), sizes)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    draws, quotas = [], []
    for s, size, target in zip(names, sizes, targets):
        left, quota = target, 0
        for p in range(3):
            # Blocks and cells in order, and within a cell by the signed hash.
            for place, i, t, n in sorted(by_source[s], key=lambda r: (r[0] >> 40, signed(r[0]))):
                if n and left:
                    block = p * source_mix.BLOCKS + (place >> 52)
                    draws.append((s, block, p, i, t, min(n, left)))
                    left, quota = left - min(n, left), block + 1
        # A whole number of passes ends with the last block of the last one.
        quotas.append(quota if size and target % size else target // size * source_mix.BLOCKS if size else 0)
    ends = np.cumsum(source_mix.split_quotas(quotas, shards, seed), axis=0)
    return [(s, p, int(np.searchsorted(ends[:, names.index(s)], block, "right")), i, t, w) for s, block, p, i, t, w in draws], ends, quotas


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_draws_equal_plain_loops(make_docs, shards):
    """Each draw's pass, shard and words; ids repeat with other texts, and the stretches of all shards cover the quotas."""
    source = random.Random(16)
    rows = [(i % 250, f"d{i} " + " ".join("w" for _ in range(source.randint(0, 60))), source.choice(["hot", "hot", "b", "c", None])) for i in range(300)]
    found = source_mix.mix(make_docs(rows), shards=shards).collect()
    got = sorted((str(r["source"]), d["pass"], d["shard"], r["doc_id"], d["words"]) for r in found for d in r["draws"])
    wanted, ends, quotas = plain_mix(rows, shards, source_mix.SEED)
    assert got == sorted((str(s), p, shard, i, w) for s, p, shard, i, _, w in wanted)
    assert ends[-1].tolist() == quotas and (np.diff(ends, axis=0) >= 0).all()
    assert all(r["taken"] == sum(d["words"] for d in r["draws"]) for r in found)


def test_shards_hold_whole_documents_in_shuffled_order(make_docs, edge_rows):
    source = random.Random(17)
    rows = edge_rows + [(1000 + i, " ".join("w" for _ in range(source.randint(0, 90))), source.choice(["hot", "b", None])) for i in range(300)]
    docs = make_docs(rows)
    mixed = source_mix.mixed_documents(docs, shards=4).collect()
    drawn = Counter((r["doc_id"], d["shard"]) for r in source_mix.mix(docs, shards=4).collect() for d in r["draws"] if 2 * d["words"] > r["size"])
    assert Counter((r["doc_id"], r["_shard"]) for r in mixed) == drawn
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(i, t) for i, t, _ in rows}
    words = sum(r["target"] for r in {r["source"]: r for r in source_mix.mix(docs, shards=4).collect()}.values())
    shuffled = source_mix.shuffled_shards(docs, part_words=ceil(words / 8), shards=4)
    assert shuffled.columns == docs.columns and shuffled.rdd.getNumPartitions() == 8
    parts = shuffled.rdd.glom().map(lambda rows: [(r["doc_id"], r["text"]) for r in rows]).collect()
    for shard in range(4):
        halves = [[(r["doc_id"], r["text"]) for r in sorted(mixed, key=lambda r: r["_order"]) if r["_shard"] == shard and (r["_order"] < 0) == (half == 1)] for half in (0, 1)]
        assert parts[2 * shard : 2 * shard + 2] == halves
    assert Counter((r["doc_id"], r["text"]) for r in shuffled.collect()) == Counter((r["doc_id"], r["text"]) for r in mixed)
    assert source_mix.shuffled_shards(make_docs([])).count() == 0
    assert [source_mix.shard_parts(words) for words in (0, 2.56e8, 2.6e8, 2.5e13)] == [1, 1, 2, 97_657]
