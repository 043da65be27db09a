"""What passes over packed cells send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_counts import dense, matrix
from topicweave.operators import cells
from topicweave.operators.cells import place_cells, place_corpus
from topicweave.operators.counts import term_counts
from topicweave.operators.svd import _Basis, truncated_svd
from topicweave.session import Scratch


@pytest.fixture(scope="module")
def blocks(corpus):
    placed = place_corpus(corpus, 6)
    yield placed
    placed.release()


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_no_factor_array_is_missing(spark, corpus, broadcast_bytes):
    """Rows without a factor row carry an empty array: missing ones are slow on their way to Arrow."""
    placed = place_cells(term_counts(corpus), 6, broadcast_bytes)
    docs = placed.cells.select("doc_id").distinct().withColumn("b", F.array(F.lit(1.0), F.lit(2.0)))
    words = placed.words.select("word", F.array(F.lit(1.0), F.lit(2.0)).alias("a"))
    for side in ((None, docs), (words, None)):
        rows = placed._with_factors(*side, 2).select(F.col("f").isNull().alias("missing"), F.size("f").alias("n"))
        assert {(r.missing, r.n) for r in rows.collect()} == {(False, 0), (False, 2)}
    placed.release()


def test_a_word_of_a_block_is_one_row(blocks):
    rows = blocks.packed(3).rows.where("mark = 1")
    assert rows.count() == rows.select("block", "key").distinct().count() == blocks.n_words
    assert rows.select(F.sum(F.size("d"))).first()[0] == blocks.n_cells


def test_few_blocks_for_few_cells(spark, corpus, monkeypatch):
    """A document's row goes to each group of words, so more blocks than tasks only cost."""
    placed = place_corpus(corpus, 64)
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert placed.packed(3).blocks == tasks
    monkeypatch.setattr(cells, "PACKED_BLOCK_CELLS", 1)
    assert placed._packed_blocks() == max(tasks, placed.n_cells)
    placed.release()


def test_basis_of_the_shorter_side(spark, corpus, blocks, monkeypatch):
    """The wide rows of the basis stand on the side that has fewer, and one pass squares them."""
    assert blocks.n_docs < blocks.n_words
    basis = _Basis(blocks, 3, Scratch(spark, "b"))
    assert basis.rows.columns == ["doc_id", "f"] and basis.rows.count() == blocks.n_docs
    one = blocks.square_sums(basis.rows.withColumnRenamed("f", "b"), 3)
    monkeypatch.setattr(type(blocks), "square_sums", lambda *a: None)
    names = sorted(r.doc_id for r in basis.rows.collect())
    two = matrix(basis.images(np.eye(3)), "doc_id", names, "s")
    assert matrix(one, "doc_id", names, "s") == pytest.approx(two, rel=1e-12)
    _, _, x = dense(corpus)
    want = np.linalg.svd(x / x.sum(), compute_uv=False)[:3]
    assert truncated_svd(blocks, 3).sigma == pytest.approx(want.tolist(), rel=1e-7)
