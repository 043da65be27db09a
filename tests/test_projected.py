"""The line search of the projected gradient against one written out densely."""

import numpy as np
import pytest

from dense_counts import dense, matrix
from topicweave.operators import projected
from topicweave.operators.cells import place_corpus
from topicweave.operators.factors import TINY
from topicweave.operators.nmf import fit_nmf, start_factors
from topicweave.session import Scratch

K = 3


@pytest.fixture(scope="module")
def blocks(corpus):
    placed = place_corpus(corpus, 3)
    yield placed
    placed.release()


@pytest.fixture(scope="module")
def start(spark, corpus, blocks):
    """Words, documents, X and the start matrices W, H (documents x topics)."""
    words, docs, x = dense(corpus)
    factors = start_factors(blocks, corpus, K, Scratch(spark, "t"))
    return words, docs, x / x.sum(), matrix(factors.words, "word", words, "f"), matrix(factors.docs, "doc_id", docs, "f")


def side(rows, other, data, limit, trace):
    """One side, a trial at a time: the step length is looked for upwards or downwards."""
    g, s = other.T @ other, data @ other
    value = lambda f: 0.5 * np.sum((f @ g) * f) - np.sum(f * s)
    alpha, turns, norm = 1.0, 0, 0.0
    for _ in range(10):
        grad = rows @ g - s
        norm = np.linalg.norm(grad[(grad < 0) | (rows > TINY)])
        if norm < limit:
            break
        turns += 1
        trial = lambda a: np.maximum(rows - a * grad, TINY)

        def suffices(a):
            d = trial(a) - rows
            return 0.99 * np.sum(grad * d) + 0.5 * np.sum((d @ g) * d) < 0

        new, tries = rows, 1
        if suffices(alpha):
            new = trial(alpha)
            alpha *= 10
            while tries < 10 and suffices(alpha) and (trial(alpha) != new).any():
                new = trial(alpha)
                alpha *= 10
                tries += 1
        else:
            while tries < 10:
                alpha /= 10
                tries += 1
                if suffices(alpha):
                    new = trial(alpha)
                    break
            else:
                alpha /= 10
        trace.append((value(rows), value(new)))
        rows = new
    return rows, norm, turns


def lin(x, w, h, n_iter, tolerance=1e-5):
    first = np.sqrt(np.sum((w @ (h.T @ h) - x @ h) ** 2) + np.sum((h @ (w.T @ w) - x.T @ w) ** 2))
    limits, trace = [max(1e-3, tolerance) * first] * 2, []
    for n in range(n_iter):
        w, a, turns = side(w, h, x, limits[0], trace)
        limits[0] /= 10 if not turns else 1
        h, b, turns = side(h, w, x.T, limits[1], trace)
        limits[1] /= 10 if not turns else 1
        if np.hypot(a, b) < tolerance * first:
            break
    return w, h, trace, n + 1


@pytest.mark.parametrize("n_iter", [1, 3])
def test_equals_dense_computation(corpus, blocks, start, n_iter):
    words, docs, x, w0, h0 = start
    want_w, want_h, trace, _ = lin(x, w0, h0, n_iter)
    assert len(trace) > n_iter  # several searched steps a side
    got = fit_nmf(blocks, K, n_iter, "Lin_PG", corpus=corpus)
    assert matrix(got.words, "word", words, "f") == pytest.approx(want_w, rel=1e-6, abs=1e-11)
    assert matrix(got.docs, "doc_id", docs, "f") == pytest.approx(want_h, rel=1e-6, abs=1e-11)
    assert all(after <= before for before, after in trace)


def test_error_never_rises(corpus, blocks):
    fitted = fit_nmf(blocks, K, 4, "Lin_PG", corpus=corpus, keep_history=True)
    errors = [r.frobenius for r in fitted.history.orderBy("iter").collect()]
    assert len(errors) == 4
    assert all(later <= before + 1e-12 for before, later in zip(errors, errors[1:]))
    assert errors[-1] < errors[0]


def test_ends_at_the_tolerance(corpus, blocks, start):
    _, _, x, w0, h0 = start
    *_, ended = lin(x, w0, h0, 40, 0.3)
    assert ended < 40
    fitted = fit_nmf(blocks, K, 40, "Lin_PG", corpus=corpus, keep_history=True, tolerance=0.3)
    assert fitted.history.count() == ended


def test_search_directions():
    """Longer steps while they suffice, shorter ones otherwise, and the rows stay if none does."""
    def sums(enough, moved=1.0):
        rows = [(-1.0 if yes else 1.0, 0.0, moved) for yes in enough]
        return np.concatenate([[0.0, 0.0], np.ravel(rows)])

    n = projected.TRIALS
    assert projected.searched(2.0, sums([True] * (n + 2) + [False] * (n - 3))) == (200.0, 2000.0)
    assert projected.searched(2.0, sums([True] * (n - 3) + [False] * (n + 2))) == (2.0 / 1e3, 2.0 / 1e3)
    assert projected.searched(2.0, sums([False] * (2 * n - 1))) == (0.0, 2.0 / BIG)
    assert projected.searched(2.0, sums([True] * (2 * n - 1))) == (2.0 * BIG / 10, 2.0 * BIG)
    assert projected.searched(2.0, sums([True] * (2 * n - 1), 0.0)) == (2.0, 20.0)


BIG = projected.BETA**projected.TRIALS
