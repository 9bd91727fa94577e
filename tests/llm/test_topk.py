import random

import numpy as np

from pyspark.sql import functions as F

from seedscape.llm import topk


def brute(rows, k):
    """Every row against every other row."""
    stored = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            stored.append((i, tuple(int(np.floor(64 * x)) for x in v)))
    out = []
    for at, (q, own) in enumerate(stored):
        if q is not None and q % 20 == 0:
            others = [(-sum(a * b for a, b in zip(own, v)), i is None, i) for n, (i, v) in enumerate(stored) if n != at]
            ranked = sorted(others, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
            out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(ranked)]
    return sorted(out, key=str)


def run(spark, rows, k, kind="array<float>"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumn("score", F.lit("clash"))
    vectors = frame.select("*", topk.quantized(F.col("embedding")).alias("vector"))
    found = topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "vector", k)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()), key=str)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.0, 0.25]) for _ in range(6)]) for i in range(300)]
    rows += [(5, rows[5][1]), (20, rows[40][1]), (40, rows[40][1]), (60, rows[60][1]), (None, rows[1][1]), (None, rows[1][1]), (None, rows[2][1]), (8, rows[8][1][:4]), (100, []), (400, None), (401, [None] * 6), (420, [float("nan")] + [0.0] * 5), (440, [float("inf")] * 6)]
    assert run(spark, rows, 20) == brute(rows, 20)
    for name, value in (("TASK_ROWS", 50), ("TASK_QUERIES", 4), ("BLOCK_ROWS", 16), ("BLOCK_QUERIES", 3)):
        monkeypatch.setattr(topk, name, value)
    assert run(spark, rows, 7) == brute(rows, 7)


def test_large_weights_and_few_candidates(spark):
    rows = [(0, [1e6, -3e5]), (20, [2e6, 1.0]), (7, [-5e6, 4e6])]
    assert run(spark, rows, 20, "array<double>") == brute(rows, 20)
    assert run(spark, rows[:1], 20, "array<double>") == []
    assert run(spark, [(1, None)], 20) == []
