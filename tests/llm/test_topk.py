"""Exact top-k against all pairs in Python's integers: extreme components, repeated ids, clashing columns."""

import math
import random

import numpy as np

from glossa.llm import topk

SCHEMA = "vec_id long, embedding array<double>, id string, score string, q string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "clash", "clash", "clash") for i, e in rows], SCHEMA)


def brute(rows, k=5):
    """Sorted rows of the result: each distinct (id, vector) of an id divisible by 50 is a query."""
    fine = [(i, [256 * int(x) if abs(x) >= 2**53 else math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in {(i, tuple(e)) for i, e in fine if i % 50 == 0}:
        found = [(max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(q, e, strict=True)))), j) for j, e in fine if j != i and len(e) == len(q)]
        out += [(i, n, j, s) for n, (s, j) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    v = topk.quantised(frame(spark, rows))
    return sorted(map(tuple, topk.top_k(v, v.where("id % 50 = 0"), k).select("query_id", "rank", "vec_id", "score").collect()))


def test_large_components(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    for k, big in enumerate([1e15, 1e18, 3e38, -1e30, 1e300, 2.0**53]):
        rows += [(100 + 50 * k, [big, 0.5, 0.0, 0.0]), (101 + 50 * k, [-big, 0.5, 0.0, 1.0]), (102 + 50 * k, [0.1, big, -big, 0.25])]
    assert run(spark, rows) == brute(rows)


def test_order_at_the_edge_of_a_long(spark):
    """Scores up to the largest long keep their order; beyond it they tie."""
    x = 2.0**62 / 256
    rows = [(50, [1 / 256, 0.0])] + [(i, [x + i * 2**20, 0.0]) for i in range(1, 8)] + [(i, [2 * x + i * 2**30, 0.0]) for i in range(20, 24)] + [(30, [-4 * x, 0.0])]
    got = run(spark, rows, 12)
    assert got == brute(rows, 12) and [r[2] for r in got[:4]] == [20, 21, 22, 23] and got[0][3] == topk.MOST and got[-1][3] == -topk.MOST


def test_repeated_ids_and_null_vectors(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in [*range(30), *range(30), 0, 0, 50, 50]] + [(50, [1.0, 1.0]), (51, [2.0, 1.0]), (100, []), (101, []), (None, [1.0] * 3), (2, None), (3, [None, 1.0, 1.0]), (4, [float("inf")] * 3), (150, [float("nan")] * 3)]
    rows += [(0, [9.0, 9.0, 9.0])] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows) == run(spark, rows[::-1])


def test_loads_and_blocks_of_any_size(spark, monkeypatch):
    """Within a load, the best of several blocks of rows with many ties."""
    r = np.random.default_rng(3)
    ids, m = r.permutation(300), r.integers(-2, 3, (300, 4)).astype(float)
    q, own = m[:20], np.arange(20, dtype=np.int64)
    whole = topk._best(q, own, [(ids, m)], 7)
    for size in (1, 3, 50):
        parts = topk._best(q, own, [(ids[k : k + size], m[k : k + size]) for k in range(0, 300, size)], 7)
        assert (np.sort(whole[0] * 1000 - whole[1]) == np.sort(parts[0] * 1000 - parts[1])).all()


def test_empty(spark):
    v = topk.quantised(frame(spark, [(0, [1.0]), (50, [2.0])]))
    assert topk.top_k(v, v.limit(0)).count() == topk.top_k(v.limit(0), v).count() == 0
    assert topk.top_k(v, v).count() == 2
