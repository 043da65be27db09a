"""Singular values with their error bounds against dense decompositions."""

import numpy as np
import pytest

from dense_counts import dense
from topicweave.operators import svd
from topicweave.operators.cells import place_cells, place_corpus
from topicweave.operators.svd import truncated_svd


def checked(x, blocks, k, **options):
    """A decomposition whose values, vectors and bounds agree with the dense one."""
    x = x / x.sum()
    want = np.linalg.svd(x, compute_uv=False)[:k]
    got = truncated_svd(blocks, k, **options)
    assert got.converged
    assert got.sigma == pytest.approx(want[: len(got.sigma)].tolist(), rel=1e-7, abs=1e-9 * want[0])
    for bound, own in zip(got.bounds, got.sigma):
        assert np.abs(np.linalg.svd(x, compute_uv=False) ** 2 - own**2).min() <= (bound + 1e-12) * want[0] ** 2
    words = {r.word: r.f for r in got.words.collect()}
    docs = {r.doc_id: r.f for r in got.docs.collect()}
    return got, words, docs


def cells_of(spark, x, n=3):
    rows = [(f"w{i}", int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return place_cells(spark.createDataFrame(rows, "word string, doc_id long, n double"), n)


def test_corpus(corpus):
    blocks = place_corpus(corpus, 3)
    words, docs, x = dense(corpus)
    got, v, u = checked(x, blocks, 4)
    v = np.array([v[w] for w in words])
    u = np.array([u[d] if d in u else np.zeros(4) for d in docs])
    assert v.T @ v == pytest.approx(np.eye(4), abs=1e-8)
    assert u.T @ u == pytest.approx(np.eye(4), abs=1e-8)
    rest = x / x.sum() - v @ np.diag(got.sigma) @ u.T
    left = np.linalg.svd(x / x.sum(), compute_uv=False)[4:]
    assert np.linalg.norm(rest) == pytest.approx(np.linalg.norm(left), rel=1e-6)
    blocks.release()


def test_flat_spectrum(spark):
    """Values that hardly differ: the bounds say when enough turns are done."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(60, 40)))[0], np.linalg.qr(rng.normal(size=(40, 40)))[0]
    x = u @ np.diag(1.0 - 0.01 * np.arange(40)) @ v.T
    x = x - x.min() + 0.1
    blocks = cells_of(spark, x)
    first = truncated_svd(blocks, 6, max_turns=2, extra=2)
    assert not first.converged and max(first.bounds) > 1e-4
    got, _, _ = checked(x, blocks, 6, extra=2)
    assert got.turns > 3
    blocks.release()


def test_pressed_basis(spark, monkeypatch):
    """The basis is pressed together every other turn and still converges."""
    monkeypatch.setattr(svd, "BASIS_WIDTHS", 2)
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, size=(40, 30)) * rng.random((40, 1))
    x[:, 0] += 1
    blocks = cells_of(spark, x)
    got, _, _ = checked(x, blocks, 3, extra=3)
    assert got.turns > 4
    blocks.release()


def test_equal_values_and_low_rank(spark):
    """Equal values appear as often as they are, and a small rank ends the turns early."""
    x = np.kron(np.eye(5), np.ones((2, 3)))  # five equal values, rank 5
    blocks = cells_of(spark, x)
    got, _, _ = checked(x, blocks, 5, extra=2)
    assert got.turns <= 2
    more = truncated_svd(blocks, 8)
    assert more.sigma[:5] == pytest.approx([more.sigma[0]] * 5)
    assert more.sigma[5:] == pytest.approx([0.0] * len(more.sigma[5:]), abs=1e-7)
    blocks.release()
