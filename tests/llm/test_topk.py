import math
import random

from pyspark.sql import functions as F

from lectern.llm import topk


def brute(rows, k, every):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in valid if i % every == 0}):
        lists = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(u, v)))), j) for u in {tuple(u) for i, u in valid if i == q} for j, v in valid if j != q and len(u) == len(v)]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(lists)[:k])]
    return out


def run(spark, rows, k=5, every=5):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, ids string, dim int").repartition(3)
    return sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % every == 0, k).collect())


def f32(x):
    import numpy as np

    return float(np.float32(x))


def test_like_brute_force(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [f32(r.choice([-1, -0.5, 0, 0.25, 1, r.random()])) for _ in range(4)]) for i in range(150)]
    rows += [(i, [f32(r.random()) for _ in range(2)]) for i in range(200, 230)]
    rows += [(300, []), (301, []), (305, []), (400, None), (405, [1.0, None, 0.0, 0.0]), (406, [math.nan, 0.0, 0.0, 0.0]), (410, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [rows[10], rows[10], rows[11], (20, [0.5, 0.5, 0.5, 0.5])]
    want = brute(rows, 5, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "MOST_BYTES", 700)
    monkeypatch.setattr(topk, "FAN", 2)
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "TILE", 4)
    assert run(spark, rows) == want


def test_large_components_are_exact(spark):
    rows = [(i, [f32(x) for x in v]) for i, v in enumerate([[2.0**25 + 4, 1.0], [2.0**25, 3.0], [2.0**26 - 4, -1.0], [-1e12, 5.0], [3e30, 1.0]])]
    assert run(spark, rows, every=2) == brute(rows, 5, 2)


def test_few_and_empty(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
