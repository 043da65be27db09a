"""Cells packed by groups of documents and words, words cleaned once, and what loops leave on disk."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dense_counts import dense
from topicweave.functions import counted, text as tx
from topicweave.functions.counted import counted_words
from topicweave.operators import cells, factors, passes
from topicweave.operators.cells import place_cells, place_corpus
from topicweave.operators.counts import term_counts, word_counts
from topicweave.session import Scratch

ODD_TEXTS = [
    "RT @user_one: Mira esto https://t.co/AbC12 //t.co/x", '"Una cita": dijo la escritora "hoy"',
    "I can't, she'll WON'T Cannot. gonna, Wanna. 'tis 'twas d'ye more'n lemme", None, "", " \t\n",
    "a\u0085b cc dd\x1cee ff.gg hh,ii 10:30 a:b :) xD '' `` ...", "x² Ⅳ ４５ ŉ ﬁre _ __ ab_ “q” ‘q’",
    "ΑΣ ΣΑΣ İstanbul Kelvin sſ", "ꟋX \U00010d50\U00010d51 new letters", "\U0001f600 wow 中文 été",
]


def test_words_cleaned_once_count_like_cleaned_texts(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    rows = df.select(
        F.array_sort(counted_words(F.col("t"))).alias("fast"),
        F.array_sort(word_counts(tx.clean_text(F.col("t")))).alias("plain"),
    ).collect()
    for text, row in zip(ODD_TEXTS, rows):
        assert row.fast == row.plain, text


@pytest.mark.parametrize("known", [1, 1000])
def test_texts_counted_in_pieces(monkeypatch, known):
    """Pieces change nothing, nor do words that were forgotten and learnt again."""
    monkeypatch.setattr(counted, "PIECE_BYTES", 8)
    monkeypatch.setattr(counted, "KNOWN_WORDS", known)
    texts = ["one two, one", None, "", "two can't ONE", "\U00010d50\U00010d51", " three\x1cthree ", "three"]
    count = counted._counter()
    for _ in range(2):
        rows = count(pa.array(texts)).to_pylist()
        found = [None if r is None else {c["word"]: c["n"] for c in r} for r in rows]
        assert found == [{"one": 2, "two": 1}, {}, {}, found[3], None, {"three": 2}, {"three": 1}]
        assert found[3]["two"] == found[3]["one"] == 1
    assert len(count(pa.array([], pa.string()))) == 0


def test_cells_of_a_block_go_to_one_group_of_documents(spark, monkeypatch):
    """Else each word of a block would be packed once per group before it travels."""
    monkeypatch.setattr(cells, "PACKED_DOCS", 20)
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma").alias("edited_text"))
    placed = place_corpus(texts, 6)
    packed = placed.packed(3)
    assert packed.doc_groups == 3 and packed.word_groups == 2
    group = F.floor(F.col("packed") / packed.word_groups)
    docs = packed.rows.where("mark = 0").select(F.col("block").alias("packed"), F.explode("d").alias("doc_id"))
    homes = docs.join(placed.cells.select("doc_id", "block").distinct(), "doc_id").select("block", group.alias("group"))
    assert homes.distinct().count() == homes.select("block").distinct().count()
    # a word comes in one row per block of the cells at most
    assert packed.rows.where("mark = 1").count() <= 3 * placed.cells.select("block").distinct().count()
    assert packed.rows.where("mark = 1").select(F.sum(F.size("d"))).first()[0] == 180
    placed.release()


@pytest.mark.parametrize("k", [3, 40])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_packed_groups_give_the_same_sums(spark, corpus, monkeypatch, k, broadcast_bytes):
    monkeypatch.setattr(cells, "PACKED_DOCS", 2)
    words, docs, x = dense(corpus)
    rng = np.random.default_rng(5)
    a, b = rng.random((len(words), k)), rng.random((len(docs), k))
    wf = spark.createDataFrame([(w, a[i].tolist()) for i, w in enumerate(words)], "word string, a array<double>")
    df = spark.createDataFrame([(d, b[j].tolist()) for j, d in enumerate(docs)], "doc_id long, b array<double>")
    placed = place_cells(term_counts(corpus), 9, broadcast_bytes)
    packed = placed.packed(k)
    assert packed.doc_groups == 3 and packed.word_groups == 3
    t = np.where(x > 0, x / (a @ b.T), 0.0)
    want = {**dict(zip(words, a * (t @ b))), **dict(zip(docs, b * (t.T @ a)))}
    both = placed.both_share_sums(wf, df, k).collect()
    assert len(both) == len({r.word or r.doc_id for r in both}) == (x.sum(1) > 0).sum() + (x.sum(0) > 0).sum()
    for r in both:
        assert r.s == pytest.approx(want[r.word or r.doc_id].tolist(), rel=1e-12)
    for key, names, sums in (("word", words, x @ b), ("doc_id", docs, x.T @ a)):
        found = placed.product_sums(df if key == "word" else wf, k, key).collect()
        for r in found:
            assert r.s == pytest.approx(sums[names.index(r[key])].tolist(), rel=1e-12)
    # a word without a factor row takes its cells away
    less = placed.share_sums(wf.where(F.col("word") != words[0]), df, k, "word").collect()
    assert {r.word for r in less} == set(words) - {words[0]}
    placed.release()


def test_many_cells_in_pieces(monkeypatch):
    """Chunks of cells give what one piece gives."""
    rng = np.random.default_rng(2)
    place, values = rng.integers(0, 50, 400), rng.random((3, 400))
    want = np.zeros((3, 50))
    for i, at in enumerate(place):
        want[:, at] += values[:, i]
    for step in (7, 400):
        got = np.zeros((3, 50))
        for at in range(0, 400, step):
            passes._add_by(place[at : at + step], values[:, at : at + step], got)
        assert got == pytest.approx(want)


def test_many_seeds_are_the_same_digests(spark, monkeypatch):
    keys = spark.createDataFrame([("word",), ("été",), ("17",)], "key string")
    many = [r[0] for r in keys.select(factors.seed_vector("w", F.col("key"), 37)).collect()]
    monkeypatch.setattr(factors, "UNROLL", 64)
    assert many == [r[0] for r in keys.select(factors.seed_vector("w", F.col("key"), 37)).collect()]


def test_written_tables_leave_no_shuffle_files(spark):
    """Turns of a loop don't pile up shuffle files until the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    before, scratch = files(), Scratch(spark, "turns")
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    for turn in range(4):
        rows = scratch.slot(rows.repartition(4, "g"), "rows", turn)
    assert rows.count() == 1000
    for _ in range(50):  # they are removed in the background
        if len(files() - before) <= 1:  # of the count
            break
        time.sleep(0.1)
    assert len(files() - before) <= 1
