"""Many topics: rows of words that follow from the words aren't kept."""

import os

import pyarrow as pa
import pytest

from dense_counts import dense, matrix
from topicweave.operators.cells import place_corpus
from topicweave.operators.plsa import fit_em, start_rows, start_values
from topicweave.session import Scratch


@pytest.fixture(scope="module")
def blocks(corpus):
    placed = place_corpus(corpus, 6)
    yield placed
    placed.release()


def test_start_rows_are_the_start_values(spark, corpus, blocks):
    words, docs, prior = start_rows(blocks, corpus, 37)
    model = start_values(blocks, corpus, 37, Scratch(spark, "s"))
    names = sorted(r.word for r in blocks.words.collect())
    assert words(pa.array(names)) == pytest.approx(matrix(model.weighted_words, "word", names, "a"), rel=1e-12)
    ids = sorted(r.doc_id for r in corpus.collect())
    assert docs(pa.array([str(i) for i in ids])) == pytest.approx(matrix(model.docs, "doc_id", ids), rel=1e-12)
    assert prior == model.topic_prior


@pytest.mark.parametrize("n_iter", [1, 3])
def test_many_topics_keep_no_rows_of_words(spark, corpus, blocks, n_iter):
    """Words' rows of the start and the last turn are found when they are read, and are the same."""
    k = 40
    scratch = Scratch(spark, "many")
    got = fit_em(blocks, k, n_iter, corpus=corpus, scratch=scratch)
    folder = scratch.path.removeprefix("file:")
    names = os.listdir(folder)
    assert not [n for n in names if n.startswith("words")]
    assert os.listdir(f"{folder}/sums-last") and not os.path.exists(f"{folder}/sums-last/side=words")
    # given the same start as tables, all turns but the last are written
    want = fit_em(blocks, k, n_iter, start_values(blocks, corpus, k, Scratch(spark, "s")), corpus, True)
    words, docs, _ = dense(corpus)
    assert got.topic_prior == pytest.approx(want.topic_prior, rel=1e-9)
    assert matrix(got.words, "word", words) == pytest.approx(matrix(want.words, "word", words), rel=1e-9)
    assert matrix(got.docs, "doc_id", docs) == pytest.approx(matrix(want.docs, "doc_id", docs), rel=1e-9)
