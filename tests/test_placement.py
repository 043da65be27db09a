"""Blocks follow the size of the input, and no document is too large for them."""

import pytest

from dense_counts import matrix
from topicweave.operators import cells
from topicweave.operators.cells import blocks_for, place_cells, place_corpus
from topicweave.operators.counts import term_counts
from topicweave.operators.metrics import residuals
from topicweave.operators.plsa import fit_em


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Fifty short documents and one with a third of all cells."""
    path = str(tmp_path_factory.mktemp("placed") / "docs")
    short = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(12))) for i in range(50)]
    large = (99, " ".join(f"own{k}" for k in range(300)))
    spark.createDataFrame([*short, large], "doc_id long, edited_text string").write.parquet(path)
    return spark.read.parquet(path)


def test_blocks_follow_the_input(written, monkeypatch):
    few = blocks_for(written)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 200)
    many = blocks_for(written)
    assert many > 4 * few
    monkeypatch.setattr(cells, "BLOCK_BYTES", 100)
    assert 1.8 * many < blocks_for(written) < 2.2 * many
    placed = place_corpus(written)
    assert placed.blocks == blocks_for(written.select("doc_id", "edited_text"))
    placed.release()


def test_one_large_document_is_spread(written):
    plain = place_corpus(written, 6)
    spread = place_corpus(written, 6, document_cells=40)
    where = lambda b: b.cells.where("doc_id = 99").groupBy("block").count().collect()
    assert len(where(plain)) == 1 and len(where(spread)) >= 4
    assert max(r["count"] for r in where(spread)) <= 150
    rows = lambda b: sorted(map(tuple, b.cells.select("word", "doc_id", "n").collect()))
    assert rows(spread) == rows(plain) == sorted(map(tuple, term_counts(written).collect()))
    assert (spread.n_docs, spread.n_words, spread.n_cells, spread.total) == (
        plain.n_docs, plain.n_words, plain.n_cells, plain.total,
    )
    words = sorted({r.word for r in plain.cells.select("word").distinct().collect()})
    a, b = fit_em(plain, 3, 2), fit_em(spread, 3, 2)
    assert matrix(a.words, "word", words) == pytest.approx(matrix(b.words, "word", words), abs=1e-12)
    plain.release(), spread.release()


@pytest.mark.parametrize("k", [2, 34])
def test_residuals_read_the_cells_once(spark, written, k):
    """The same measures as cell by cell, with few topics and with slabs; one scan of the cells."""
    import numpy as np

    placed = place_cells(term_counts(written).where("doc_id < 6"), 3)
    rng = np.random.default_rng(1)
    cells_ = placed.cells.collect()
    words = sorted({r.word for r in cells_}) + ["absent"]
    docs = sorted({r.doc_id for r in cells_}) + [77]
    w, h = rng.random((len(words), k)) + 0.1, rng.random((len(docs), k)) + 0.1
    frame = lambda keys, m, spec: spark.createDataFrame([(x, r.tolist()) for x, r in zip(keys, m)], spec)
    row = residuals(placed, frame(words, w, "word string, a array<double>"), frame(docs, h, "doc_id long, b array<double>"), k).first()
    x = np.zeros((len(words), len(docs)))
    for r in cells_:
        x[words.index(r.word), docs.index(r.doc_id)] = r.n / placed.total
    model = w @ h.T
    ratio = np.where(x > 0, x / model, 0.0)
    held = x > 0
    assert row.kl == pytest.approx((x[held] * np.log(ratio[held])).sum() - x.sum() + model.sum())
    assert row.frobenius == pytest.approx(np.linalg.norm(x - model))
    assert row.kkt_w == pytest.approx(np.abs(np.minimum(w, h.sum(0) - ratio @ h)).sum())
    assert row.kkt_h == pytest.approx(np.abs(np.minimum(h, w.sum(0) - ratio.T @ w)).sum())
    placed.release()
