"""Exact search against brute force, ties, huge components, and hard cases."""

import math
import random

import pytest

from mixtura.llm import topk


def floors(v):
    return [math.floor(256 * x) if abs(x) < 2**45 else 256 * int(x) for x in v]


def brute(rows, k):
    good = [(i, floors(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for j, w in good if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, ids string, cell int").repartition(5)
    return sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 50 = 0"), k).collect()))


@pytest.fixture
def rows():
    rng = random.Random(5)
    some = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.1]) for _ in range(rng.choice([3, 3, 3, 4, 0]))]) for i in range(300)]
    huge = [(450, [1e300, 2.0]), (451, [-1e300, 5.0]), (452, [1e10, 2.0**40 + 0.5]), (453, [1e8, 1e8])]
    none = [(None, [1.0]), (50, None), (100, [None, 1.0]), (150, [float("nan")]), (200, [float("inf"), 0.0])]
    return some + huge + none + [(100, [0.1, 0.2])] * 2


def test_matches_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows, 5)


def test_small_tiles_and_a_deep_tree_change_nothing(spark, rows, monkeypatch):
    for name, n in (("TILE", 2), ("SHARD", 7), ("CELL", 2), ("FAN", 2), ("TILE_NUMBERS", 8), ("SHARD_NUMBERS", 28)):
        monkeypatch.setattr(topk, name, n)
    assert found(spark, rows, 3) == brute(rows, 3)


def test_few_or_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (51, [0.5])]) == [(50, 1, 51, 32768)]
