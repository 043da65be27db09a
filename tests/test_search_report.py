import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_counts import matrix
from topicweave.model import TopicModel
from topicweave.operators import report, search as srch

WORDS = ["apple", "brake", "engine", "pear"]
W = np.array([[0.6, 1e-7], [1e-7, 0.3], [0.1, 0.7], [0.3, 1e-7]])
PRIOR = [0.55, 0.45]


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(5)
    d = rng.random((60, 2)) ** 6
    d /= d.sum(axis=0)
    d[10] = d[11]  # a tie
    words = spark.createDataFrame([(w, p.tolist()) for w, p in zip(WORDS, W)], "word string, p array<double>")
    docs = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(d)], "doc_id long, p array<double>")
    return TopicModel(words, docs, PRIOR)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("screen_name"),
        F.concat(F.lit("text "), "id").alias("full_text"),
    )


def fold_dense(weights, n_iter=70):
    q = np.full(2, 0.5)
    a = np.maximum(W, 1e-12) * PRIOR
    for _ in range(n_iter):
        post = a * q / (a * q).sum(axis=1, keepdims=True)
        m = (weights[:, None] * post).sum(axis=0)
        q = np.maximum(m / m.sum(), 1e-12)
    return q


def expected(model, q, top=5, threshold=1e-2):
    d = matrix(model.docs, "doc_id", range(60))
    scores = d @ q
    ranked = sorted(range(60), key=lambda i: (-round(scores[i], 9), i))
    return [(i, round(scores[i], 9)) for i in ranked[:top] if scores[i] > threshold]


def test_search_equals_brute_force(model, texts):
    q = fold_dense(np.array([1.0, 0, 0, 1.0]))
    hits = srch.search(model, texts, "the Apple PEAR apple pear,").orderBy("rank").collect()
    assert [(h.doc_id, pytest.approx(h.score)) for h in hits] == expected(model, fold_dense(np.array([1.0, 0, 0, 0])))
    hits = srch.search(model, texts, "Apple PEAR apple").orderBy("rank").collect()
    assert [(h.doc_id, h.score) for h in hits] == [
        (i, pytest.approx(s)) for i, s in expected(model, q)
    ]
    assert hits[0].full_text == f"text {hits[0].doc_id}"


def test_repeated_words_count_once(spark, model):
    queries = spark.createDataFrame([(1, "apple apple engine"), (2, "apple engine")], "query_id int, query string")
    folded = {r.query_id: r.q for r in srch.fold_in(model, queries).collect()}
    assert folded[1] == folded[2] == pytest.approx(fold_dense(np.array([1.0, 0, 1.0, 0])).tolist())


def test_unknown_and_empty_queries(model, texts):
    with pytest.raises(ValueError):
        srch.search(model, texts, "")
    assert srch.search(model, texts, "zzz").count() == 0
    q = fold_dense(np.full(4, 1e-12), 5)
    hits = srch.search(model, texts, "zzz", allow_oov=True, n_iter=5).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [i for i, _ in expected(model, q)]


def test_smooth_fold_in_equals_dense(model):
    weights = np.array([1.0, 1e-12, 1e-12, 1e-12])
    got = srch.fold_in_all_words(model, "apple", 4)
    assert got == pytest.approx(fold_dense(weights, 4).tolist())


ASKED = {1: ("apple", [1, 0, 0, 0]), 2: ("engine pear", [0, 0, 1, 1]), 3: ("zzz", [0, 0, 0, 0]), 4: ("apple zzz", [1, 0, 0, 0])}


@pytest.mark.parametrize("values", [250_000, 4])
def test_smooth_fold_in_of_a_table(spark, model, values):
    """All queries at once, and in blocks of few queries."""
    queries = spark.createDataFrame([(i, t) for i, (t, _) in ASKED.items()], "query_id int, query string")
    folded = {r.query_id: r for r in srch.fold_in_smooth(model, queries, 6, values).collect()}
    assert sorted(folded) == sorted(ASKED)
    for i, (_, held) in ASKED.items():
        weights = np.where(np.array(held) > 0, 1.0, 1e-12)
        assert folded[i].q == pytest.approx(fold_dense(weights, 6).tolist())
        assert folded[i].matched == sum(held)
    assert srch.fold_in_smooth(model, queries.where("query_id > 9")).count() == 0


def test_smooth_batch_equals_single_searches(spark, model, texts):
    queries = spark.createDataFrame([(2, "engine pear"), (3, "zzz"), (5, "")], "query_id int, query string")
    got = srch.search_batch(model, texts, queries, threshold=1e-3, n_iter=3, smooth=True)
    rows = got.orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {2, 3}
    for i in (2, 3):
        one = srch.search(model, texts, ASKED[i][0], threshold=1e-3, n_iter=3, smooth=True)
        own = [(r.doc_id, r.score) for r in rows if r.query_id == i]
        assert own == [(r.doc_id, pytest.approx(r.score, abs=2e-9)) for r in one.orderBy("rank").collect()]


@pytest.mark.parametrize("threshold", [1e-2, 1e-3, 2e-2])
@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_batch_search_equals_brute_force(spark, model, texts, threshold, limit, monkeypatch):
    monkeypatch.setattr(srch, "BROADCAST_BYTES", limit)
    weights = {1: [1.0, 0, 0, 0], 2: [0, 1.0, 1.0, 0], 3: [1.0, 0, 1.0, 1.0]}
    queries = spark.createDataFrame(
        [(1, "apple"), (2, "engine brake"), (3, "pear engine apple"), (4, "zzz")],
        "query_id int, query string",
    )
    got = srch.search_batch(model, texts, queries, threshold=threshold, n_iter=20)
    rows = got.orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} <= {1, 2, 3}
    for query_id, w in weights.items():
        q = fold_dense(np.array(w), 20)
        hits = [(r.doc_id, r.score) for r in rows if r.query_id == query_id]
        assert hits == [(i, pytest.approx(s)) for i, s in expected(model, q, threshold=threshold)]


def test_top_words_and_summary(model):
    rows = report.top_words(model.words, 2).orderBy("z", "rank").collect()
    assert [(r.z, r.word) for r in rows] == [(0, "apple"), (0, "pear"), (1, "engine"), (1, "brake")]
    lines = {r.z: r.summary for r in report.topic_summary(model.words, 2).collect()}
    assert lines == {0: "Topic #0: apple pear", 1: "Topic #1: engine brake"}
    with pytest.raises(ValueError):
        report.top_words(model.words, 0)
    with pytest.raises(ValueError):
        report.top_words(None)


def test_document_reports(model, texts):
    d = matrix(model.docs, "doc_id", range(60))
    best = {r.doc_id: r.z for r in report.dominant_topic(model.docs).collect()}
    assert best == {i: int(np.argmax(np.round(d[i], 9))) for i in range(60)}
    one = {r.z: r.doc_id for r in report.best_doc_per_topic(model, texts).collect()}
    assert one == {z: int(np.argmax(np.round(d[:, z], 9))) for z in range(2)}
    for z in range(2):
        rows = report.top_docs(model, texts, n_topic=z, n_top_docs=12).orderBy("rank").collect()
        want = sorted(range(60), key=lambda i: (-round(d[i, z], 9), i))[:12]
        assert [r.doc_id for r in rows] == want


def test_few_hits_are_looked_up_in_the_scan(spark, model, tmp_path):
    """The ids of the hits reach the file scan."""
    path = str(tmp_path / "docs")
    rows = spark.range(60).selectExpr("id AS doc_id", "'s' AS screen_name", "concat('text ', id) AS full_text")
    rows.write.parquet(path)
    hits = spark.createDataFrame([(7, 0.5), (9, 0.4)], "doc_id long, score double")
    found = report.with_documents(hits, spark.read.parquet(path), 5)
    assert sorted((r.doc_id, r.full_text) for r in found.collect()) == [(7, "text 7"), (9, "text 9")]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(doc_id, [7,9])" in plan
    for limit in (50_000, 10**9):
        more = report.with_documents(hits, spark.read.parquet(path), limit)
        assert sorted(r.doc_id for r in more.collect()) == [7, 9]
