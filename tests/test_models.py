import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_counts import dense, matrix
from topicweave.engine import TopicEngine
from topicweave.operators.cells import place_cells, place_corpus
from topicweave.operators.counts import term_counts
from topicweave.operators.factors import EPSILON, TINY
from topicweave.operators.gram import active_set_step, nnls_step, warm_set_step
from topicweave.operators.metrics import residuals
from topicweave.operators.nmf import METHODS, Factors, fit_nmf, nmf_to_plsa, start_factors
from topicweave.operators.plsa import fit_em, posterior, start_values
from topicweave.session import Scratch

K = 3


@pytest.fixture(scope="module")
def blocks(corpus):
    placed = place_corpus(corpus, 3)
    yield placed
    placed.release()


@pytest.fixture(scope="module")
def counts(corpus):
    return dense(corpus)


def em_dense(x, w, d, z, n_iter):
    for _ in range(n_iter):
        joint = z[None, None, :] * w[:, None, :] * d[None, :, :]
        r = x[:, :, None] * joint / joint.sum(axis=2, keepdims=True)
        m = r.sum(axis=(0, 1))
        w = np.maximum(r.sum(axis=1) / m, EPSILON)
        d = np.maximum(r.sum(axis=0) / m, EPSILON)
        z = m / m.sum()
    return w, d, z


def test_em_equals_dense_computation(spark, corpus, blocks, counts):
    words, docs, x = counts
    start = start_values(blocks, corpus, K, Scratch(spark, "t"))
    w0, d0 = matrix(start.words, "word", words), matrix(start.docs, "doc_id", docs)
    want = em_dense(x, w0, d0, np.array(start.topic_prior), 4)
    model = fit_em(blocks, K, 4, corpus=corpus)
    assert matrix(model.words, "word", words) == pytest.approx(want[0], abs=1e-12)
    assert matrix(model.docs, "doc_id", docs) == pytest.approx(want[1], abs=1e-12)
    assert model.topic_prior == pytest.approx(want[2].tolist(), abs=1e-12)
    assert sum(model.topic_prior) == pytest.approx(1.0)
    # documents without a counted word stay at the floor
    assert matrix(model.docs, "doc_id", [7, 8]).tolist() == [[EPSILON] * K] * 2
    joint = posterior(term_counts(corpus), model).select(F.aggregate("p", F.lit(0.0), lambda a, b: a + b))
    assert all(r[0] == pytest.approx(1.0) for r in joint.collect())
    values = model.reconstruct(term_counts(corpus)).collect()
    dense_model = (want[0] * want[2]) @ want[1].T
    for r in values:
        assert r.p == pytest.approx(dense_model[words.index(r.word), docs.index(r.doc_id)])


def test_em_does_not_depend_on_placement(corpus, counts):
    words, _, _ = counts
    one = place_corpus(corpus, 1)
    many = place_cells(term_counts(corpus), 5, broadcast_bytes=0, document_cells=2)
    a, b = fit_em(one, 2, 2), fit_em(many, 2, 2)
    assert matrix(a.words, "word", words) == pytest.approx(matrix(b.words, "word", words), abs=1e-12)
    one.release(), many.release()


def test_em_recovers_disjoint_blocks(spark):
    cells = spark.createDataFrame(
        [(f"w{i}", j, 1.0) for i in range(4) for j in range(4) if i // 2 == j // 2],
        "word string, doc_id long, n double",
    )
    lean = lambda i, side: [0.4, 0.1] if i // 2 == side else [0.1, 0.4]
    start = Factors(
        spark.createDataFrame([(f"w{i}", lean(i, 0)) for i in range(4)], "word string, f array<double>"),
        spark.createDataFrame([(j, lean(j, 0)) for j in range(4)], "doc_id long, f array<double>"),
        2,
    )
    placed = place_cells(cells, 2)
    model = fit_em(placed, 2, 12, start=nmf_to_plsa(start))
    w = matrix(model.words, "word", [f"w{i}" for i in range(4)])
    assert w[:2, 0] == pytest.approx([0.5, 0.5], abs=1e-5)
    assert w[2:, 0] == pytest.approx([EPSILON, EPSILON])
    placed.release()


def test_one_topic_gives_the_marginals(corpus, blocks, counts):
    words, _, x = counts
    model = fit_em(blocks, 1, 1, corpus=corpus)
    assert matrix(model.words, "word", words)[:, 0] == pytest.approx(x.sum(axis=1) / x.sum())
    assert model.topic_prior == [1.0]


def kl(x, wh):
    return float((x[x > 0] * np.log(x[x > 0] / wh[x > 0])).sum() - x.sum() + wh.sum())


def nmf_dense(x, w, h, n_iter, method):
    update, first = METHODS[method]

    def half(mine, other, data):
        if update == "divergence":
            ratio = np.where(data > 0, data / (mine @ other.T), 0.0)
            mass = np.maximum(other.sum(axis=0), TINY)
            return np.maximum(mine * (ratio @ other) / mass, TINY)
        return update(mine, data @ other, other.T @ other)

    for _ in range(n_iter):
        for side in ("words", "docs") if first == "words" else ("docs", "words"):
            if side == "words":
                w = half(w, h, x)
            else:
                h = half(h, w, x.T)
    return w, h


@pytest.mark.parametrize("method", ["sklearn", "nimfa_MU", "simple_MU", "HALS", "ANLS_BLOCKPIVOT", "ANLS_AS_NUMPY", "ANLS_AS_GROUP"])
def test_nmf_equals_dense_computation(spark, corpus, blocks, counts, method):
    words, docs, x = counts
    x = x / x.sum()
    start = start_factors(blocks, corpus, K, Scratch(spark, "t"))
    w0, h0 = matrix(start.words, "word", words, "f"), matrix(start.docs, "doc_id", docs, "f")
    want_w, want_h = nmf_dense(x, w0, h0, 2, method)
    got = fit_nmf(blocks, K, 2, method, corpus=corpus)
    w, h = matrix(got.words, "word", words, "f"), matrix(got.docs, "doc_id", docs, "f")
    assert w @ h.T == pytest.approx(want_w @ want_h.T, abs=1e-9)
    model = nmf_to_plsa(got)
    p1, p2 = matrix(model.words, "word", words), matrix(model.docs, "doc_id", docs)
    scale = (w.sum(axis=0) * h.sum(axis=0)).sum()
    assert (p1 * np.array(model.topic_prior)) @ p2.T * scale == pytest.approx(w @ h.T, abs=1e-15)


def test_residuals_equal_dense_computation_and_fall(spark, corpus, blocks, counts):
    words, docs, x = counts
    x = x / x.sum()
    for method, column in [("sklearn", "kl"), ("simple_MU", "frobenius")]:
        fitted = fit_nmf(blocks, K, 3, method, corpus=corpus, keep_history=True)
        rows = fitted.history.orderBy("iter").collect()
        values = [r[column] for r in rows]
        assert all(later <= before + 1e-12 for before, later in zip(values, values[1:]))
        w, h = matrix(fitted.words, "word", words, "f"), matrix(fitted.docs, "doc_id", docs, "f")
        wh = w @ h.T
        ratio = np.where(x > 0, x / wh, 0.0)
        assert rows[-1].kl == pytest.approx(kl(x, wh))
        assert rows[-1].frobenius == pytest.approx(np.linalg.norm(x - wh), rel=1e-6)
        assert rows[-1].kkt_w == pytest.approx(np.abs(np.minimum(w, h.sum(0) - ratio @ h)).sum())
        assert rows[-1].kkt_h == pytest.approx(np.abs(np.minimum(h, w.sum(0) - ratio.T @ w)).sum())


def test_em_likelihood_never_falls(corpus, blocks):
    from topicweave.operators.metrics import log_likelihood

    values = []
    for n in (1, 2, 4):
        m = fit_em(blocks, K, n, corpus=corpus)
        h = m.docs.select("doc_id", F.col("p").alias("b"))
        values.append(log_likelihood(blocks, m.weighted_words, h, K).first()[0])
    assert values == sorted(values)


SOLVERS = [nnls_step, active_set_step, warm_set_step]


def kkt(x, target, g):
    """Largest violation of the optimality conditions, relative to the problem's own scale."""
    root = np.sqrt(np.diag(g))
    x = np.where(x > TINY, x, 0.0)  # the floor stands for zero
    y = (x @ g - target) / root / np.abs(target / root).max()
    x = x * root / np.abs(target / root).max()
    return np.abs(np.minimum(x, y)).max()


@pytest.mark.parametrize("solver", SOLVERS)
@pytest.mark.parametrize("scale", [1.0, 1e-3])
def test_nnls_is_exact(solver, scale):
    rng = np.random.default_rng(1)
    h = rng.random((30, 6)) * np.array([1, 1e-2, 1, 10, 1, 1])
    x = rng.normal(size=(200, 30)) * scale
    got = solver(rng.random((200, 6)) * scale, x @ h, h.T @ h)
    assert (got >= 0).all() and (got > TINY).any(axis=0).all()
    assert kkt(got, x @ h, h.T @ h) < 1e-9


@pytest.mark.parametrize("solver", SOLVERS)
def test_nnls_keeps_its_scale(solver):
    """The same problem in units of 1e-12, and exact optimum by trying all passive sets."""
    from itertools import product

    rng = np.random.default_rng(5)
    h, x = rng.random((12, 4)), rng.normal(size=(40, 12))
    g, t = h.T @ h, x @ h
    small = solver(np.zeros((40, 4)), t * 1e-6, g * 1e-12) * 1e-6
    assert small == pytest.approx(solver(np.zeros((40, 4)), t, g), abs=2e-12)
    for row, own in zip(t, solver(rng.random((40, 4)), t, g)):
        best, held = 0.0, np.zeros(4)
        for chosen in product([False, True], repeat=4):
            p = np.array(chosen)
            sol = np.zeros(4)
            if p.any():
                sol[p] = np.linalg.solve(g[np.ix_(p, p)], row[p])
            if (sol >= 0).all() and 0.5 * sol @ g @ sol - sol @ row < best:
                best, held = 0.5 * sol @ g @ sol - sol @ row, sol
        assert own == pytest.approx(held, abs=1e-9)


@pytest.mark.parametrize("solver", SOLVERS)
def test_nnls_ends_on_dependent_topics(solver):
    """Equal, nearly equal, summed and empty topics: optimal values, and an end."""
    rng = np.random.default_rng(9)
    base = rng.random((25, 3))
    near = base[:, 0] * (1 + 1e-9 * rng.random(25))
    h = np.column_stack([base, base[:, 0], near, base[:, 1] + base[:, 2], np.zeros(25)])
    for scale in (1.0, 1e-6):
        x = rng.normal(size=(300, 25)) * scale
        g, t = h.T @ h * scale, x @ h
        got = solver(np.abs(rng.normal(size=(300, 7))), t, g)
        want = nnls_step(np.zeros((300, 3)), x @ base, base.T @ base * scale)
        value = lambda f, gram, s: (0.5 * (f @ gram) * f - f * s).sum(axis=1)
        assert (got >= 0).all()
        low = value(got, g, t)
        assert low == pytest.approx(value(want, base.T @ base * scale, x @ base), abs=1e-7 * np.abs(low).max())


def test_many_topics_equal_dense_computation(spark, corpus, blocks, counts):
    words, docs, x = counts
    k = 40  # beyond the unrolled size
    start = start_values(blocks, corpus, k, Scratch(spark, "t"))
    w0, d0 = matrix(start.words, "word", words), matrix(start.docs, "doc_id", docs)
    want = em_dense(x, w0, d0, np.array(start.topic_prior), 2)
    model = fit_em(blocks, k, 2, corpus=corpus)
    assert matrix(model.words, "word", words) == pytest.approx(want[0], abs=1e-12)
    assert matrix(model.docs, "doc_id", docs) == pytest.approx(want[1], abs=1e-12)
    assert model.topic_prior == pytest.approx(want[2].tolist(), abs=1e-12)


def test_engine_rejects_bad_arguments(spark, corpus):
    engine = TopicEngine(spark)
    with pytest.raises(ValueError):
        engine.get_corpus()
    engine.set_corpus(corpus)
    with pytest.raises(ValueError):
        engine.compute_probabilities(method="nothing")
    with pytest.raises(ValueError):
        engine.compute_probabilities(n_topics=0)


def test_engine_runs_end_to_end(spark, corpus):
    engine = TopicEngine(spark, corpus)
    x, frequencies, words = engine.generate_matrix()
    assert x.count() == frequencies.count() and words.count() == 9
    start = Factors(
        words.select("word", F.array(F.lit(0.2), F.rand(1)).alias("f")),
        corpus.select("doc_id", F.array(F.rand(2), F.lit(0.3)).alias("f")),
        2,
    )
    warm = engine.compute_probabilities("EM", 2, 2, init=start)
    assert engine.top_words(warm, 3).count() == 6
    ones = frequencies.withColumn("n", F.lit(1.0))
    assert engine.compute_probabilities("HALS", 2, 2, cells=ones).k == 2
    by_default = engine.compute_probabilities("sklearn", 2, 2)
    assert engine.search("apple", by_default).count() > 0
    engine.release()
