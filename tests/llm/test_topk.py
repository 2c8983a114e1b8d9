from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from findrift.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, bucket int"


def brute(rows, k, every=20):
    vectors: dict[int, list[list[int]]] = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = set()
    for q, own in vectors.items():
        if q % every:
            continue
        best = []
        for i, others in vectors.items():
            if i != q:
                best.append((-max(sum(a * b for a, b in zip(x, y)) for x in own for y in others), i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])}
    return out


def run(spark, rows, **more):
    df = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, **more)
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def vectors(rng, n, shape):
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(8)]
        size = math.sqrt(sum(x * x for x in v))
        scale = {"unit": 1.0, "skewed": rng.paretovariate(1.0), "tied": 1.0}[shape]
        v = [0.0 if shape == "tied" and rng.random() < 0.7 else float.fromhex(float(x / size * scale).hex()) for x in v]
        out.append((i, [float(f"{x:.3f}") for x in v], 1, 2, 3))
    return out


@pytest.mark.parametrize("shape", ["unit", "skewed", "tied"])
@pytest.mark.parametrize("bucket_rows", [30, 10_000])
def test_against_brute_force(spark, shape, bucket_rows):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in vectors(random.Random(4), 400, shape)]
    assert run(spark, rows, k=5, bucket_rows=bucket_rows, query_rows=7) == brute(rows, 5)


def test_near_copies_use_coordinates(spark):
    import numpy as np

    rng, rows = np.random.default_rng(1), []
    for c in range(20):
        centre = rng.normal(size=16)
        for j in range(20):
            v = (centre + 0.02 * rng.normal(size=16)).astype(np.float32)
            rows.append((c * 20 + j, [float(x) for x in v], 0, 0, 0))
    assert run(spark, rows, k=3, bucket_rows=50, query_rows=64) == brute(rows, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0, 0, 0), (1, None, 0, 0, 0), (2, [1.0, None], 0, 0, 0), (3, [nan, 1.0], 0, 0, 0), (4, [inf, 1.0], 0, 0, 0), (5, [], 0, 0, 0),
            (6, [0.0, 0.0], 0, 0, 0), (7, [1.0], 0, 0, 0), (8, [1.0, 1.0, 9.0], 0, 0, 0), (9, [-1.0, -1.0], 0, 0, 0), (9, [2.0, 2.0], 0, 0, 0),
            (20, [0.5, 0.5], 0, 0, 0), (20, [0.5, 0.5], 0, 0, 0), (40, None, 0, 0, 0), (None, [1.0], 0, 0, 0), (10, [3e20, 1.0], 0, 0, 0)]
    got = run(spark, [r for r in rows if r[0] != 10], k=20)
    assert got == brute([r for r in rows if r[0] != 10], 20)
    assert len(run(spark, rows, k=20)) == len(got) + 2
    assert run(spark, [], k=3) == set()
    assert run(spark, rows[:1], k=3) == set()
