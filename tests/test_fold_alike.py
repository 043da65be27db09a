"""Folds over the whole vocabulary: a turn reads each distinct row of words once."""

import numpy as np
import pytest

from topicweave.model import TopicModel
from topicweave.operators import search as srch


@pytest.mark.parametrize("values", [1, 125_000])
def test_alike_words_are_folded_as_one_row(spark, monkeypatch, values):
    """Words at the floor are one row of a turn with their number, but for those a query asks for."""
    monkeypatch.setattr(srch, "SMOOTH_VALUES", values)
    w = np.array([[0.4, 1e-7], [1e-7, 0.5]] + [[1e-7, 1e-7]] * 300 + [[1e-7, 0.2]])
    names = [f"w{i}" for i in range(len(w))]
    words = spark.createDataFrame([(n, p.tolist()) for n, p in zip(names, w)], "word string, p array<double>")
    model, sizes = TopicModel(words, None, [0.6, 0.4]), []
    sums = srch._smooth_sums

    def rows_of(packed):
        return sum(len(r.times) // 8 for r in packed.collect())

    monkeypatch.setattr(srch, "_smooth_sums", lambda packed, q: sizes.append(rows_of(packed)) or sums(packed, q))
    texts = {1: "w0 w5", 2: "w5 w7 w302", 3: "zzz", 4: "w1"}
    # one id in two rows asks for a word twice
    asked = [(i, t) for i, t in texts.items()] + [(4, "w1")]
    folded = srch.fold_in_smooth(model, spark.createDataFrame(asked, "query_id int, query string"), 5)
    rows = {r.query_id: r for r in folded.collect()}
    assert sizes == [6] * 5
    for i, text in texts.items():
        weights = np.array([float(n in text.split()) or 1e-12 for n in names]) * (1 + (i == 4))
        weights[weights < 1] = 1e-12
        q, a = np.full(2, 0.5), w * [0.6, 0.4]
        for _ in range(5):
            m = (weights[:, None] * a * q / (a @ q)[:, None]).sum(axis=0)
            q = np.maximum(m / m.sum(), 1e-12)
        assert rows[i].q == pytest.approx(q.tolist(), rel=1e-12)
        assert rows[i].matched == (weights * (weights >= 1)).sum()
