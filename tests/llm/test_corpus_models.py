import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import hashing, importance, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary text; every sixth document has bad words, every fifth is shouted junk."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lan ter mis pon res kal".split()]
    bad = ["wretchling", "snarkbag", "dolthead"]
    rows, marks = [], []
    for i in range(900):
        text = [plain[k] for k in rng.integers(0, len(plain), 60)]
        toxic, junk = int(i % 6 == 0), int(i % 5 == 0)
        if toxic:
            for k in rng.integers(0, 60, 4):
                text[k] = bad[k % 3]
        if junk:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        marks.append((i, 1 - junk, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(corpus, spark):
    docs, labels = corpus
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit, miss = out[out.toxic == 1].predicted.mean(), out[out.toxic == 0].predicted.mean()
    assert hit > 0.9 and miss < 0.03
    # Labels that are held out must not matter.
    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    again = toxicity.score(docs, toxicity.train(docs, turned)).toPandas().sort_values("doc_id")
    before = toxicity.score(docs, toxicity.train(docs, labels)).toPandas().sort_values("doc_id")
    assert (again.score.to_numpy() == before.score.to_numpy()).all()


def test_toxicity_edges(docs, labels, nothing, rows):
    import zlib

    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    unlabelled = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 7")))
    assert {r.score for r in unlabelled.collect()} == {0.0}
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert toxicity.windows("a " * 25)[0] == b" " + b"a " * 10 and toxicity.windows("") == []


def test_importance_keeps_good(corpus):
    docs, labels = corpus
    model = importance.fit(docs, labels)
    drawn, last, k = importance.draw(docs, model)
    out = drawn.join(labels, "doc_id").toPandas()
    assert out.drawn.sum() == k and out[out.quality == 1].drawn.mean() > 0.99 and out[out.quality == 0].drawn.mean() < 0.05
    assert importance.keep_drawn(docs, model, last).count() == k


def test_importance_weights_by_hand(docs, rows):
    ratios = np.random.default_rng(0).normal(size=importance.BUCKETS)
    got = importance._weights(docs, ratios, ["doc_id"]).collect()
    expected = []
    for i, t, *_ in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        n = 2 * len(w) - 1 if w else 0
        expected.append((str(i), n))
    assert sorted((str(r.doc_id), r.n_grams) for r in got) == sorted(expected)
    # One word's hash is the same wherever it stands, A-Z lower-cased.
    a = hashing.words(np.frombuffer(b"The cat  THE\tdog", dtype=np.uint8))
    b = hashing.words(np.frombuffer(b"dog the", dtype=np.uint8))
    assert a[0] == a[2] == b[1] and a[3] == b[0] and len(set(a.tolist())) == 3


def test_importance_edges(docs, labels, nothing):
    model = importance.fit(docs, labels)
    drawn, last, k = importance.draw(docs, model)
    out = {r.doc_id: r for r in drawn.collect()}
    assert not out[4].drawn and not out[5].drawn and not out[6].drawn
    kept = importance.keep_drawn(docs, model, last)
    assert kept.columns == docs.columns and kept.count() >= k
    plain = importance.fit(docs, labels.where("quality = 7"))
    assert plain.level == -np.inf and not plain.ratios.any()
    every, _, n = importance.draw(docs, plain)
    assert n == every.where("drawn").count() == every.where("n_grams > 0").count()
    empty = importance.fit(nothing, labels)
    assert importance.draw(nothing, empty)[0].count() == 0


def _toxic_world(n_words, wrong, rows=toxicity.SAMPLE, seed=5):
    import random

    draw = random.Random(seed)
    invent = lambda: "".join(draw.choice("bcdfglmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 5)))
    plain, bad = [invent() for _ in range(2000)], [invent() for _ in range(n_words)]

    def text(toxic):
        words = [plain[min(1999, int(draw.expovariate(0.004)))] for _ in range(80)]
        for _ in range(4 if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(bad)
        return " ".join(words)

    labelled = [[text(True) for _ in range(rows)], [text(False) for _ in range(rows)]]
    k = int(wrong * rows)
    swapped = [labelled[0][k:] + labelled[1][:k], labelled[1][k:] + labelled[0][:k]]
    for part in swapped:
        draw.shuffle(part)
    return swapped, [[text(t) for _ in range(400)] for t in (True, False)]


@pytest.mark.parametrize("n_words, wrong, least", [(10, 0.04, 0.9), (200, 0.0, 0.8), (200, 0.04, 0.7)])
def test_toxic_vocabulary(n_words, wrong, least):
    taught, unseen = _toxic_world(n_words, wrong)
    model = toxicity.fit(*taught)
    hits = [sum(model.score(t) >= toxicity.CUT for t in part) / len(part) for part in unseen]
    assert hits[0] >= least and hits[1] <= 0.06
