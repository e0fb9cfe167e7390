import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siltra.llm import packing as pk


def test_hilbert_neighbours_are_adjacent():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = pk.hilbert(grid, bits)
        assert sorted(keys) == list(range(1 << bits * d))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_best_fit_uses_few_bins():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(0, 401) for _ in range(rng.randrange(1, 300))]
        bins = pk.best_fit(sizes, 400)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 400 for b in bins)
        assert len(bins) <= 11 / 9 * max(1, math.ceil(sum(sizes) / 400)) + 1 or len(bins) <= sum(s > 133 for s in sizes)


def check(rows, got, capacity=400):
    fill, where, pieces = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        fill[r.source, r.page, r.container_id] += r.n_words
        where[r.container_id].add((r.source, r.page))
        pieces[r.chunk_no].append((r.piece_no, r.n_words))
    assert all(v <= capacity for v in fill.values())
    assert all(len(v) == 1 for v in where.values())
    for no, source, page, text in rows:
        n = len((text or "").split())
        p = sorted(pieces[no])
        assert [i for i, _ in p] == list(range(len(p))) and sum(x for _, x in p) == n
        assert len(p) == 1 if n <= capacity else all(x == capacity for _, x in p[:-1])
    return fill


@pytest.mark.parametrize("hot", [0, 3000])
def test_every_record_is_packed_once(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice([None, "a.pdf", "b.md"]), rng.choice([None, 1, 2]), " ".join(rng.choice(["x", "yy z"]) for _ in range(rng.choice([0, 5, 100, 390, 450, 1300])))) for i in range(120)]
    rows += [(1000, "a.pdf", 1, None), (1001, "c", 1, "")] + [(5000 + i, "hot", 1, "w " * rng.randrange(10, 120)) for i in range(hot)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "chunk_no long, source string, page int, text string, key string")
    fill = check(rows, pk.pack_containers(df).collect())
    if hot:
        mine = [v for (s, _, _), v in fill.items() if s == "hot"]
        assert len(mine) <= sum(mine) / 400 * 1.02 + 8


def test_containers_hold_neighbours_of_the_curve():
    # one group of 3000 records, numbered along the curve
    rng = random.Random(7)
    sizes = [rng.randrange(0, 120) for _ in range(3000)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(["a"] * 3000), pa.array([1] * 3000, pa.int32()), pa.array(sizes, pa.int64())], names=["key", "source", "page", "n"])
    inside = defaultdict(list)
    for b in pk._pack(400)([rows]):
        for r in b.to_pylist():
            inside[r["container_id"]].append(r["key"])
    assert sorted(k for ks in inside.values() for k in ks) == list(range(3000))
    assert all(sum(sizes[k] for k in ks) <= 400 for ks in inside.values())
    assert np.mean([max(ks) - min(ks) for ks in inside.values()]) < 150
    assert len(inside) <= sum(sizes) / 400 * 1.02 + 2


def test_empty_table(spark):
    assert pk.pack_containers(spark.createDataFrame([], "chunk_no long, source string, page int, text string")).count() == 0
