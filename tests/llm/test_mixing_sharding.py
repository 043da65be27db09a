from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import mixing, sharding


def level(sizes, weights, budget, cap):
    """Water level by halving: what each source gets."""
    total = budget * sum(sizes)
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(cap * s, w * high) for s, w in zip(sizes, weights)]


def test_targets_and_copies(docs):
    out = mixing.plan_copies(docs).collect()
    assert len(out) == docs.count()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    assert names == ["S3", "s1", "s2", None]
    expected = level([sizes[n] for n in names], [3, 1, 2, 3], 1.5, 2.0)
    largest = max(r["size"] for r in out)
    for name, target in zip(names, expected):
        own = [r for r in out if r.source == name]
        assert own[0].target == pytest.approx(target)
        assert abs(sum(r["size"] * r.copies for r in own) - target) <= largest
        assert all(0 <= r.copies <= 2 for r in own)


def test_rerun_agrees_and_emits(docs, nothing):
    plan = mixing.plan_copies(docs)
    again = mixing.plan_copies(docs.repartition(7))
    key = lambda rows: sorted((str(r.doc_id), r["size"], r._key_a, r.copies) for r in rows)
    assert key(plan.collect()) == key(again.collect())
    emitted = mixing.emit(docs, plan)
    assert emitted.columns == docs.columns
    assert emitted.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.plan_copies(nothing).count() == 0


def test_copies_follow_integer_boundaries(spark):
    """All sizes equal: a source's documents cross one boundary per 1/rate documents."""
    rows = [(i, "a b c d", "s" if i % 4 else "t") for i in range(400)]
    out = mixing.plan_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s", "t"):
        own = sorted((r.doc_id, r.copies) for r in out if r.source == s)
        rate = next(r.target / r.source_size for r in out if r.source == s)
        sums = np.cumsum([c for _, c in own])
        assert np.abs(sums - rate * np.arange(1, len(own) + 1)).max() <= 1 + 1e-9


def test_permutation_is_one_and_comes_back():
    for n in (1, 2, 3, 24, 1000, 4097):
        order = sharding.permute(np.arange(n), n, 3)
        assert sorted(order) == list(range(n))
        assert (sharding.permute(order, n, 3, inverse=True) == np.arange(n)).all()
    assert (np.diff(sharding.permute(np.arange(1000), 1000, 3)) == 1).mean() < 0.05


def test_shards(docs, rows, nothing):
    import zlib

    out = sharding.shard(docs).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(counts[k]))
    assert sorted(r.row for r in out) == list(range(len(rows)))
    for r in out:
        assert (r.shard, r.slot) == sharding.locate(r.row, r.n_rows)
        assert sharding.row_at(r.shard, r.slot, r.n_rows) == r.row
    expected = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == expected
    assert sharding.shard(nothing).count() == 0
