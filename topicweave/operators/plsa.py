"""PLSA by expectation maximisation as an iterative DataFrame job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import UNROLL, build, column_sums, dot, literal, total
from topicweave.model import TopicModel
from topicweave.operators.cells import CellBlocks
from topicweave.operators.factors import (
    EPSILON,
    normalised,
    seed_mass,
    seed_rows,
    seed_topics,
    seed_vector,
    shares,
)
from topicweave.operators.gram import map_rows
from topicweave.operators.metrics import residuals
from topicweave.session import Scratch


def start_values(
    blocks: CellBlocks, corpus: DataFrame | None, k: int, scratch: Scratch
) -> TopicModel:
    """Reproducible start: uniform values, each topic normalised, then floored."""
    spark = blocks.cells.sparkSession
    docs = (corpus if corpus is not None else blocks.cells).select("doc_id").distinct()
    words = scratch.write(
        blocks.words.select("word", seed_vector("w", F.col("word"), k).alias("s")), "words-start"
    )
    docs = scratch.write(
        docs.select("doc_id", seed_vector("d", F.col("doc_id"), k).alias("s")), "docs-start"
    )
    words = normalised(words, "word", column_sums(words, "s", k).scalar(), k, EPSILON)
    docs = normalised(docs, "doc_id", column_sums(docs, "s", k).scalar(), k, EPSILON)
    many = k > UNROLL
    return TopicModel(
        words=scratch.settled(words, "words-start-p", many),
        docs=scratch.settled(docs, "docs-start-p", many),
        topic_prior=seed_topics(spark, k),
    )


def start_rows(
    blocks: CellBlocks, corpus: DataFrame | None, k: int
) -> tuple[Callable, Callable, list[float]]:
    """:func:`start_values` as functions from keys to rows, ``P(z) P(w|z)`` of words and ``P(d|z)`` of
    documents, and P(z): for many topics the values are cheaper to find again than to keep.
    """
    docs = (corpus if corpus is not None else blocks.cells).select("doc_id").distinct()
    prior = seed_topics(blocks.cells.sparkSession, k)
    by = np.array(prior)
    of_word, of_doc = seed_rows("w", k), seed_rows("d", k)
    word_share = shares(seed_mass(blocks.words, "word", "w", k), EPSILON)
    doc_share = shares(seed_mass(docs, "doc_id", "d", k), EPSILON)
    return lambda keys: word_share(of_word(keys)) * by, lambda keys: doc_share(of_doc(keys)), prior


def floored(model: TopicModel, scratch: Scratch) -> TopicModel:
    """A given start with both conditionals floored."""

    def floor(factor: DataFrame, key: str) -> DataFrame:
        raised = build(model.k, lambda z: f"greatest(p[{z}], {EPSILON!r}D)")
        return scratch.settled(
            factor.select(key, raised.alias("p")), f"{key}-floored", model.k > UNROLL
        )

    return TopicModel(floor(model.words, "word"), floor(model.docs, "doc_id"), model.topic_prior)


def posterior(cells: DataFrame | CellBlocks, model: TopicModel) -> DataFrame:
    """``(word, doc_id, p)`` with the array ``p[z] = P(z|w,d)`` of every cell.

    Placed cells stay where they lie.
    """
    k = model.k
    if isinstance(cells, CellBlocks):
        docs = model.docs.select("doc_id", F.col("p").alias("b"))
        return cells.values(model.weighted_words, docs, k, True)
    joined = model.with_cells(cells)
    totals = joined.withColumn("total", F.expr(dot("a", "b", k)))
    shares = build(k, lambda z: f"a[{z}] * b[{z}] / total")
    return totals.select("word", "doc_id", shares.alias("p"))


def _prior(mass: DataFrame, k: int) -> DataFrame:
    """P(z) as one row from the topic masses."""
    with_total = mass.select("m", F.expr(total(k, lambda z: f"m[{z}]")).alias("total"))
    return with_total.select(build(k, lambda z: f"m[{z}] / total").alias("prior"))


def _weighted(words: DataFrame, mass: DataFrame, k: int) -> DataFrame:
    """``a[z] = P(z) P(w|z)`` from word sums and their topic mass."""
    weighted = build(
        k,
        lambda z: f"greatest(IF(m[{z}] > 0, s[{z}] / m[{z}], 0D), {EPSILON!r}D) * prior[{z}]",
    )
    rows = words.withColumn("m", mass.scalar()).withColumn("prior", _prior(mass, k).scalar())
    return rows.select("word", weighted.alias("a"))


def _every_document(docs: DataFrame, corpus: DataFrame | None, name: str, k: int) -> DataFrame:
    """Documents without a counted word stay at the floor."""
    if corpus is None:
        return docs
    floor = F.array(*[F.lit(EPSILON)] * k)
    every = corpus.select("doc_id").distinct().join(docs, "doc_id", "left")
    return every.select("doc_id", F.coalesce(name, floor).alias(name))


def _last_of_many(
    blocks: CellBlocks, words_a, docs_b, k: int, corpus: DataFrame | None, scratch: Scratch
) -> TopicModel:
    """The last turn of many topics. Its word sums, the largest table by far, aren't kept: their
    masses are, and P(w|z) is a pass over the cells when it is read.
    """
    both = scratch.write(blocks.mass_and_doc_sums(words_a, docs_b, k), "sums-last", "side")
    masses = both.where("side = 'measures'").first()["s"]
    share = shares(masses, EPSILON)

    def divided(sums: DataFrame, key: str) -> DataFrame:
        return map_rows(sums, key, ["s"], share, "p")

    docs = divided(both.where("side = 'docs'").select("doc_id", "s"), "doc_id")
    return TopicModel(
        words=divided(blocks.share_sums(words_a, docs_b, k, "word"), "word"),
        docs=scratch.write(_every_document(docs, corpus, "p", k), "docs-p"),
        topic_prior=[m / sum(masses) for m in masses],
    )


def fit_em(
    blocks: CellBlocks,
    k: int,
    n_iter: int,
    start: TopicModel | None = None,
    corpus: DataFrame | None = None,
    keep_history: bool = False,
    scratch: Scratch | None = None,
) -> TopicModel:
    """Fit P(w|z), P(d|z), P(z) on placed cells; fixed number of iterations.

    ``corpus`` names every document, so that documents without a counted word
    appear in P(d|z) (at the floor). ``start`` is a warm start. With more than ``UNROLL`` topics
    P(w|z) of the model is found by a pass over the placed cells each time it is read; write it to
    read it often, and before the cells are released.
    """
    spark = blocks.cells.sparkSession
    scratch = scratch or Scratch(spark, "plsa")
    many = k > UNROLL
    if many and n_iter and start is None:
        words_a, docs_b, _ = start_rows(blocks, corpus, k)
    else:
        model = floored(start, scratch) if start else start_values(blocks, corpus, k, scratch)
        words_a = model.weighted_words
        docs_b = model.docs.select("doc_id", F.col("p").alias("b"))
    word_sums = doc_sums = None
    history = None
    for turn in range(n_iter):
        if many and turn == n_iter - 1 and not keep_history:
            return _last_of_many(blocks, words_a, docs_b, k, corpus, scratch)
        # both factors are renewed from the same posterior, in one pass over the cells
        both = scratch.slot(blocks.both_share_sums(words_a, docs_b, k), "sums", turn, "side")
        word_sums = both.where("side = 'words'").select("word", "s")
        doc_sums = both.where("side = 'docs'").select("doc_id", "s")
        mass = column_sums(word_sums, "s", k)
        words_a = _weighted(word_sums, mass, k)
        docs_b = normalised(doc_sums, "doc_id", mass.scalar(), k, EPSILON, "b")
        if keep_history:
            row = residuals(blocks, words_a, _every_document(docs_b, corpus, "b", k), k)
            row = row.select(F.lit("EM").alias("method"), F.lit(turn + 1).alias("iter"), "*")
            row = scratch.write(row, f"history/iter={turn + 1}").select(row.columns)
            history = row if history is None else history.unionByName(row)
    if n_iter == 0:
        return model
    masses = column_sums(word_sums, "s", k).first()["m"]
    words = normalised(word_sums, "word", literal(masses), k, EPSILON)
    docs = normalised(doc_sums, "doc_id", literal(masses), k, EPSILON)
    docs = scratch.write(_every_document(docs, corpus, "p", k), "docs-p")
    return TopicModel(
        words=scratch.settled(words, "words-p", k > UNROLL),
        docs=docs,
        topic_prior=[m / sum(masses) for m in masses],
        history=history,
    )
