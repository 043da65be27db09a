"""Every document and word counts: weighted fits, residuals, least squares, slabs of topics."""

import numpy as np
import pytest

from dense_counts import dense, matrix
from topicweave.engine import TopicEngine
from topicweave.functions.vectors import slabs
from topicweave.operators.cells import place_cells
from topicweave.operators.gram import active_set, nnls_step
from topicweave.operators.metrics import residuals
from topicweave.operators.plsa import fit_em
from topicweave.operators.search import search_batch
from topicweave.session import scratch_root


def test_weights_of_few_documents_keep_all(spark, corpus):
    cells = spark.createDataFrame([("apple", 1, 2.0), ("pear", 2, 1.0)], "word string, doc_id long, n double")
    engine = TopicEngine(spark)
    engine.set_corpus(corpus)
    for method in ("EM", "sklearn"):
        model = engine.compute_probabilities(method, 2, 2, cells=cells)
        assert model.docs.count() == corpus.count()


def test_residuals_count_rows_without_a_cell(spark, corpus):
    words, docs, _ = dense(corpus)
    cells = spark.createDataFrame([("apple", 1, 2.0), ("pear", 2, 1.0)], "word string, doc_id long, n double")
    placed = place_cells(cells)
    rng = np.random.default_rng(0)
    w, h = rng.random((len(words), 2)), rng.random((len(docs), 2))
    frames = [
        spark.createDataFrame([(k, r.tolist()) for k, r in zip(keys, m)], f"{name} {kind}, {col} array<double>")
        for keys, m, name, kind, col in [(words, w, "word", "string", "a"), (docs, h, "doc_id", "long", "b")]
    ]
    row = residuals(placed, *frames, 2).first()
    placed.release()
    x = np.zeros((len(words), len(docs)))
    x[words.index("apple"), docs.index(1)] = 2 / 3
    x[words.index("pear"), docs.index(2)] = 1 / 3
    t = x / (w @ h.T)
    assert row.kkt_w == pytest.approx(np.abs(np.minimum(w, h.sum(0) - t @ h)).sum())
    assert row.kkt_h == pytest.approx(np.abs(np.minimum(h, w.sum(0) - t.T @ w)).sum())


@pytest.mark.parametrize("solve", ["pivots", "descent"])
def test_least_squares_leave_no_row_open(solve):
    rng = np.random.default_rng(1)
    for k in (2, 5, 12):
        base = rng.normal(size=(3 * k, k)) + 1.0
        g, target = base.T @ base, rng.normal(size=(200, k)) * 10
        x = nnls_step(np.zeros_like(target), target, g) if solve == "pivots" else active_set(target, g)
        slope = x @ g - target
        assert (x >= 0).all() and slope.min() > -1e-6
        assert np.abs(np.where(x > 1e-9, slope, 0)).max() < 1e-5


def test_slabs_share_topics_out():
    assert slabs(32) == (1, 32) and slabs(33) == (2, 17) and slabs(37) == (2, 19) and slabs(200) == (7, 29)


def test_prime_number_of_topics(spark, corpus):
    from topicweave.operators.cells import place_corpus

    words, docs, x = dense(corpus)
    placed = place_corpus(corpus, 2)
    one = fit_em(placed, 37, 1, corpus=corpus)
    placed.release()
    total = matrix(one.words, "word", words).sum(axis=0)
    assert total.shape == (37,) and total == pytest.approx(np.ones(37), abs=1e-6)


def test_batch_search_answers_strangers(spark, corpus):
    from topicweave.operators.cells import place_corpus

    placed = place_corpus(corpus, 2)
    model = fit_em(placed, 2, 3, corpus=corpus)
    asked = spark.createDataFrame([(1, "apple"), (2, "zzz"), (3, "")], "query_id int, query string")
    plain = search_batch(model, corpus, asked, threshold=1e-3)
    assert {r.query_id for r in plain.collect()} == {1}
    every = search_batch(model, corpus, asked, threshold=1e-3, allow_oov=True)
    assert {r.query_id for r in every.collect()} == {1, 2}
    placed.release()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "local-cluster[2,1,512]"

    class Session:
        sparkContext = Elsewhere()

        class conf:
            @staticmethod
            def get(_key, _default=None):
                return None

    with pytest.raises(ValueError):
        scratch_root(Session())
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
