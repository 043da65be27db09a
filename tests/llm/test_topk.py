import math
import random

import pytest
from pyspark.sql import functions as F

from topicweave.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string, row long, weights string"


def brute(rows, k=10, n=100):
    held = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((at, i, [math.floor(1024 * x) for x in v]))
    out = []
    for at, i, q in held:
        if i is None or i % n:
            continue
        clip = lambda x: max(1 - (1 << 63), min((1 << 63) - 1, x))
        scored = [(-clip(sum(x * y for x, y in zip(q, w))), j is None, j) for b, j, w in held if b != at]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def answer(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA).repartition(3)
    out = topk.top_k(frame, F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def vectors(rng, n, dims=12):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    common = [0.25] * dims
    rows += [(n + i, common) for i in range(60)]  # ties
    rows += [(200, rows[200][1]), (300, [0.5]), (None, [1.0] * dims), (None, [1.0] * dims)]
    rows += [(400, None), (500, [1.0, None]), (600, [float("nan")]), (700, [float("inf")] * dims)]
    rows += [(800, []), (900, [0.0] * dims), (1000, [0.0] * (dims - 1) + [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("block,pass_bytes", [(2048, 1 << 20), (7, 700)])
def test_equals_brute_force(spark, block, pass_bytes):
    rows = vectors(random.Random(2), 450)
    random.Random(3).shuffle(rows)
    assert answer(spark, rows, pass_bytes=pass_bytes, block=block, group=3) == brute(rows)


def test_sparse_terms_and_few_candidates(spark):
    rng = random.Random(7)
    rows = [(i * 50, [rng.choice([0.0, 0.0, 0.0, 0.0, 1.5]) for _ in range(40)]) for i in range(8)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, rows, k=3) == brute(rows, 3)
    assert answer(spark, []) == []
    assert answer(spark, [(100, [1.0])]) == []
    assert answer(spark, [(7, [1.0]), (8, [2.0])]) == []


def test_large_numbers_are_exact(spark):
    big = 2.0**45
    rows = [(0, [big, 1.0]), (1, [big, 0.5]), (2, [big, 0.75]), (3, [-big, 1.0]), (4, [2.0**20, 3.0])]
    assert answer(spark, rows) == brute(rows)
