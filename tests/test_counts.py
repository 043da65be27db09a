import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_counts import dense
from topicweave.operators.cells import place_cells, place_corpus
from topicweave.operators.counts import (
    joint_distribution,
    query_membership,
    term_counts,
    vocabulary,
)
from topicweave.operators.ranking import top_per_group
from topicweave.operators import ranking


def test_term_counts_equal_brute_force(corpus):
    words, docs, x = dense(corpus)
    got = {(r.word, r.doc_id): r.n for r in term_counts(corpus).collect()}
    want = {
        (w, d): x[i, j] for i, w in enumerate(words) for j, d in enumerate(docs) if x[i, j] > 0
    }
    assert got == want


def test_joint_distribution_sums_to_one(corpus):
    cells = term_counts(corpus)
    assert joint_distribution(cells).agg(F.sum("x")).first()[0] == pytest.approx(1.0)


def test_vocabulary_is_alphabetical(corpus):
    words, _, _ = dense(corpus)
    rows = vocabulary(term_counts(corpus)).orderBy("word_id").collect()
    assert [(r.word_id, r.word) for r in rows] == list(enumerate(words))


def test_query_membership(spark, corpus):
    vocab = vocabulary(term_counts(corpus))
    terms = spark.createDataFrame([("apple",), ("nothing",), ("apple",)], "word string")
    weights = {r.word: r.n for r in query_membership(vocab, terms).collect()}
    assert weights["apple"] == 1.0 and weights["wheel"] == 1e-12
    assert "nothing" not in weights


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
@pytest.mark.parametrize("document_cells", [2, 1_000_000])
def test_sums_agree_however_cells_are_placed(spark, corpus, broadcast_bytes, document_cells):
    words, docs, x = dense(corpus)
    rng = np.random.default_rng(3)
    a, b = rng.random((len(words), 3)), rng.random((len(docs), 3))
    wf = spark.createDataFrame([(w, a[i].tolist()) for i, w in enumerate(words)],
                               "word string, a array<double>")
    df = spark.createDataFrame([(d, b[j].tolist()) for j, d in enumerate(docs)],
                               "doc_id long, b array<double>")
    blocks = place_cells(term_counts(corpus), 3, broadcast_bytes, document_cells)
    assert (blocks.split_docs is not None) == (document_cells == 2)
    t = np.where(x > 0, x / (a @ b.T), 0.0)
    by_word, by_doc = a * (t @ b), b * (t.T @ a)

    def check(sums, key, names, want):
        got = {r[key]: r.s for r in sums.collect()}
        for n, row in zip(names, want):
            if row.sum() > 0:
                assert got[n] == pytest.approx(row.tolist(), rel=1e-12)

    check(blocks.share_sums(wf, df, 3, "word"), "word", words, by_word)
    check(blocks.share_sums(wf, df, 3, "doc_id"), "doc_id", docs, by_doc)
    check(blocks.product_sums(df, 3, "word"), "word", words, x @ b)
    check(blocks.product_sums(wf, 3, "doc_id"), "doc_id", docs, x.T @ a)
    both = blocks.both_share_sums(wf, df, 3).collect()
    assert {r.word for r in both if r.side == "words"} == set(words)
    for r in both:
        want = by_word[words.index(r.word)] if r.side == "words" else by_doc[docs.index(r.doc_id)]
        assert r.s == pytest.approx(want.tolist(), rel=1e-12)
    blocks.release()


def test_routed_join_leaves_the_cells_where_they_are(spark, corpus):
    blocks = place_corpus(corpus, 3, broadcast_bytes=0)
    words = blocks.cells.select("word").distinct().withColumn("a", F.array(F.lit(1.0)))
    docs = blocks.cells.select("doc_id").distinct().withColumn("b", F.array(F.lit(1.0)))
    joined = blocks.joined(words, docs, 1)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "CartesianProduct" not in plan
    executed = joined._jdf.queryExecution().executedPlan().toString()
    probe = executed[: executed.index("InMemoryTableScan")]
    assert "Exchange" not in probe  # nothing between the joins and the stored cells
    blocks.release()


def test_top_per_group_same_with_and_without_salt(spark, monkeypatch):
    rows = [(g, (i * 37) % 101) for g in ("x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int").withColumn("i", F.monotonically_increasing_id())
    order = [F.desc("v"), F.asc("i")]
    plain = sorted(map(tuple, top_per_group(df, ["g"], order, 7).collect()))
    monkeypatch.setattr(ranking, "BUILT_IN_LIMIT", 1)
    assert sorted(map(tuple, top_per_group(df, ["g"], order, 7).collect())) == plain
