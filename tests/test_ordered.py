import random

import numpy as np
import pytest

from factloom.operators import ordered, pages


def plain_batches(sizes, limit):
    used = batch = 0
    out = []
    for k, n in enumerate(sizes):
        if k and used + n > limit:
            used, batch = 0, batch + 1
        used += n
        out.append(batch)
    return out, used


def some_rows(seed=1):
    """Half of all rows under one key, null keys, sizes of nothing and beyond any limit."""
    source = random.Random(seed)
    rows = [(source.choice(["hot", "hot", "a", None, "b"]), i, source.choice([0, 1, 2, 5, 9, 30, 200]) if i % 11 else None) for i in range(900)]
    return source.sample(rows, len(rows))


@pytest.mark.parametrize("cuts", [1, 3, 40])
def test_summaries_of_ranges_compose(cuts):
    source = random.Random(cuts)
    for _ in range(60):
        sizes, limit = [source.choice([0, 1, 3, 7, 12, 40]) for _ in range(source.randint(1, 60))], source.choice([1, 10, 25])
        edges = sorted({0, len(sizes), *(source.randrange(len(sizes) + 1) for _ in range(cuts))})
        used = batch = 0
        got = []
        for a, b in zip(edges, edges[1:]):
            part = np.array(sizes[a:b], np.int64)
            got += ordered._fill(part, limit, a == 0, used, batch).tolist()
            used, batch = ordered.after(ordered.summarise(part, limit, a == 0), used, batch, a == 0)
        wanted, last = plain_batches(sizes, limit)
        assert got == wanted and (used, batch) == (last, wanted[-1])


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_a_hot_key_over_many_ranges(spark, ranges):
    rows = some_rows()
    table = spark.createDataFrame(rows, "package string, ord int, size int")
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in {r[0] for r in rows}}
    packed = {r["ord"]: (r["package"], r["batch"], r["too_large"]) for r in pages.packed_batches(table, "package", ("ord",), "size", 40, ranges).collect()}
    caps = {r["ord"]: r["output_cap"] for r in pages.output_caps(table, 20_000, "size", "size", ("package",), ("ord",), ranges).collect()}
    dealt = {r["ord"]: r["batch"] for r in pages.balanced_batches(table, 7, ("package",), ("ord",), ranges).collect()}
    assert len(packed) == len(caps) == len(dealt) == len(rows)
    for key, mine in by_key.items():
        sizes = [r[2] or 0 for r in mine]
        assert [packed[r[1]] for r in mine] == [(key, b, n > 40) for b, n in zip(plain_batches(sizes, 40)[0], sizes)]
        assert [caps[r[1]] for r in mine] == [max(0, 20_000 - sum(sizes[:k]) - sum(sizes[k + 1 :])) for k in range(len(sizes))]
        assert [dealt[r[1]] for r in mine] == [b + 1 for b, part in enumerate(np.array_split(sizes, 7)) for _ in part]
    if ranges == 60:
        assert ordered.ranged(table, ("package",), ("ord",), 60).filter("package = 'hot'").select("_range").distinct().count() > 10


def test_no_rows(spark):
    empty = spark.createDataFrame([], "package string, ord int, size int")
    assert pages.packed_batches(empty, "package", ("ord",), "size", 40).count() == pages.balanced_batches(empty, 3, ("package",), ("ord",)).count() == 0
    few = spark.createDataFrame([("p", 1, 5), ("p", 2, 5)], empty.schema)
    assert sorted(r["batch"] for r in pages.balanced_batches(few, 4, ("package",), ("ord",)).collect()) == [1, 2]
