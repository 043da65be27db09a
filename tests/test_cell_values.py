"""Values of placed cells, fit measures and start values that take no row per cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_counts import dense
from topicweave.functions.vectors import rounded
from topicweave.model import TopicModel
from topicweave.operators import cells, factors, passes
from topicweave.operators.cells import CellBlocks, place_cells, place_corpus
from topicweave.operators.counts import term_counts
from topicweave.operators.metrics import residuals
from topicweave.operators.plsa import posterior


def random_model(spark, corpus, k):
    words, docs, x = dense(corpus)
    rng = np.random.default_rng(4)
    a, b = rng.random((len(words), k)), rng.random((len(docs), k))
    prior = [1.0] * k
    wf = spark.createDataFrame([(w, a[i].tolist()) for i, w in enumerate(words)], "word string, p array<double>")
    df = spark.createDataFrame([(d, b[j].tolist()) for j, d in enumerate(docs)], "doc_id long, p array<double>")
    return TopicModel(wf, df, prior), words, docs, x, a, b


@pytest.mark.parametrize("k", [3, 40])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_values_of_placed_cells(spark, corpus, monkeypatch, k, broadcast_bytes):
    """Posteriors and reconstructions of a cleaned corpus; its cells don't travel."""
    monkeypatch.setattr(cells, "PACKED_DOCS", 3)
    monkeypatch.setattr(passes, "PIECE_BYTES", 9)
    model, words, docs, x, a, b = random_model(spark, corpus, k)
    placed = place_corpus(corpus.select("doc_id", "full_text"), 4, broadcast_bytes)
    for found, shares in ((posterior(placed, model), True), (model.reconstruct(placed), False)):
        outside = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "ShuffledHashJoin" not in outside and "hashpartitioning(key" not in outside
        rows = found.collect()
        assert len(rows) == (x > 0).sum()
        for r in rows:
            own = a[words.index(r.word)] * b[docs.index(r.doc_id)]
            want = own / own.sum() if shares else own.sum()
            assert r.p == pytest.approx(want.tolist() if shares else want, rel=1e-12)
    placed.release()


def test_values_of_cells_without_a_count(spark, corpus):
    model, words, docs, x, a, b = random_model(spark, corpus, 3)
    counted = term_counts(corpus)
    some = counted.withColumn("n", F.when(F.col("word") != words[0], F.col("n")))
    placed = place_cells(some, 3, 0)
    assert placed.uncounted == (x[0] > 0).sum() > 0
    assert model.reconstruct(placed).count() == posterior(placed, model).count() == (x > 0).sum()
    placed.release()


@pytest.mark.parametrize("k", [1, 40])
def test_measures_take_no_row_per_cell(spark, corpus, monkeypatch, k):
    def joined(*_):
        raise AssertionError("Cells were joined with factor rows.")

    monkeypatch.setattr(CellBlocks, "joined", joined)
    model, words, docs, x, a, b = random_model(spark, corpus, k)
    placed = place_corpus(corpus.select("doc_id", "full_text"), 4, 0)
    h = model.docs.select("doc_id", F.col("p").alias("b"))
    row = residuals(placed, model.weighted_words, h, k).first()
    m, x = a @ b.T, x / x.sum()
    t = np.where(x > 0, x / m, 0.0)
    kl = (np.where(x > 0, x * np.log(np.where(x > 0, x / m, 1.0)), 0.0) - x + m).sum()
    assert row.kl == pytest.approx(kl, rel=1e-10)
    assert row.frobenius == pytest.approx(np.sqrt(((x - m) ** 2).sum()), rel=1e-10)
    assert row.kkt_w == pytest.approx(np.abs(np.minimum(a, b.sum(0) - t @ b)).sum(), rel=1e-10)
    assert row.kkt_h == pytest.approx(np.abs(np.minimum(b, a.sum(0) - t.T @ a)).sum(), rel=1e-10)
    placed.release()


def test_seeds_are_the_digest_numbers(spark, monkeypatch):
    """In batches as by column, also of a null key."""
    keys = spark.createDataFrame([("word",), ("été",), (None,)], "key string")
    fast = keys.select(factors.seed_vector("w", F.col("key"), 5)).collect()
    monkeypatch.setattr(factors, "UNROLL", 64)
    assert fast == keys.select(factors.seed_vector("w", F.col("key"), 5)).collect()


def test_rounded_like_round(spark):
    values = [0.0, 1.0, 0.00048828125, 1 / 3, 2 / 3, 1.19e-7, 5e-11, 4.9e-11, 0.99999999999, 2.5, -0.3, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select(rounded(F.col("v"), 10).alias("fast"), F.round("v", 10).alias("plain")).collect():
        assert r.fast == r.plain or (r.fast != r.fast and r.plain != r.plain)


def test_vocabulary_is_kept(spark, corpus):
    placed = place_corpus(corpus.select("doc_id", "full_text"), 3)
    assert placed.words.is_cached and placed.words.count() == placed.n_words
    placed.release()
