import hashlib
from collections import Counter

import numpy as np
import pytest

from topicweave.llm import repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_against_all_strings(docs, rows, limit, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", limit)
    small = docs.where("doc_id is null or doc_id <> 13")
    kept = [r for r in rows if r[0] != 13]
    out = repeats.remove_repeats(small).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    found = brute([r[1] for r in kept], 200)
    assert got == sorted((str(r[0]), *f) for r, f in zip(kept, found))
    assert sum(f[1] for f in found) > 2000


def test_long_texts_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 3000)
    rng = np.random.default_rng(0)
    block = bytes(rng.integers(97, 123, 900, dtype=np.uint8)).decode()
    filler = [bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode() for n in (9000, 3100, 500)]
    texts = [filler[0][:2900] + block[:400] + filler[0][2900:] + block[100:700], filler[1] + block, block[300:550] + filler[2], "ab" * 400, "q" * 199]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in out] == brute(texts, 200)
    for r, t in zip(out, texts):
        assert sum(s.high - s.low for s in r.spans) == r.n_removed


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    n, width = 300, 40
    rows = rng.integers(97, 99, (n, width), dtype=np.uint8)
    rows[150:] = rows[:150]
    sizes = rng.integers(0, width + 1, n)
    rows[np.arange(width) >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, 5, n))
    s = repeats.Suffixes(rows, sizes, group)
    order, common = s.neighbours(s.order())
    keys = [(group[i], rows[i, : sizes[i]].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, n):
        a, b = keys[k - 1], keys[k]
        same = next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
        assert common[k] == (same if a[0] == b[0] else -1)


def test_nothing(nothing):
    assert repeats.remove_repeats(nothing).count() == 0
