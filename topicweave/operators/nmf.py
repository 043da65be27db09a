"""Non-negative matrix factorisation ``X ~ W H`` of the joint distribution.

One half-step renews all rows of one factor: a pass over the cells gives one sum
per word (or document) and topic, and a K x K matrix or K column sums stand for
the other factor. Methods differ only in the row update.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import UNROLL, build, column_sums, literal
from topicweave.model import TopicModel
from topicweave.operators.cells import CellBlocks
from topicweave.operators.factors import TINY, seed_vector
from topicweave.operators.gram import (
    active_set_step,
    gram,
    hals_step,
    map_rows,
    multiplicative_step,
    nnls_step,
    warm_set_step,
)
from topicweave.operators.metrics import residuals
from topicweave.operators.projected import Progress, descended, gradient_square, step_rows
from topicweave.session import Scratch

# Method names and the factor each one renews first.
METHODS = {
    "sklearn": ("divergence", "words"),
    "nimfa_MU": ("divergence", "docs"),
    "simple_MU": (multiplicative_step, "docs"),
    "Lin_PG": ("projected", "words"),
    "ANLS_BLOCKPIVOT": (nnls_step, "docs"),
    "ANLS_AS_NUMPY": (active_set_step, "docs"),
    "ANLS_AS_GROUP": (warm_set_step, "docs"),
    "HALS": (hals_step, "docs"),
}
METRICS = ("kullback-leibler", "frobenius")


@dataclass(frozen=True)
class Factors:
    """W as ``(word, f)``, H as ``(doc_id, f)``; f is an array of K values."""

    words: DataFrame
    docs: DataFrame
    k: int
    history: DataFrame | None = None


def start_factors(
    blocks: CellBlocks, corpus: DataFrame | None, k: int, scratch: Scratch
) -> Factors:
    """Reproducible uniform start whose product has the mean of X."""
    docs = (corpus if corpus is not None else blocks.cells).select("doc_id").distinct()
    docs = scratch.write(docs, "doc-ids")
    scale = 2.0 * math.sqrt(1.0 / (blocks.n_words * docs.count() * k))

    def scaled(prefix: str, key: str):
        seeds = seed_vector(prefix, F.col(key), k)
        return F.transform(seeds, lambda u: F.greatest(u * scale, F.lit(TINY)))

    words = blocks.words.select("word", scaled("w", "word").alias("f"))
    docs = docs.select("doc_id", scaled("d", "doc_id").alias("f"))
    return Factors(scratch.write(words, "w-start"), scratch.write(docs, "h-start"), k)


def _products(
    blocks: CellBlocks, factors: Factors, side: str, scratch: Scratch
) -> DataFrame:
    """``(key, s)``: products of X with the other side's factor."""
    k = factors.k
    key = "word" if side == "words" else "doc_id"
    if side == "words":
        sums = blocks.product_sums(factors.docs.withColumnRenamed("f", "b"), k, key)
    else:
        sums = blocks.product_sums(factors.words.withColumnRenamed("f", "a"), k, key)
    sums = scratch.settled(sums, f"{side}-sums", k > UNROLL)
    return sums.select(key, build(k, lambda z: f"s[{z}] / {blocks.total!r}D").alias("s"))


class _Projected:
    """Half-steps by projected gradient with a line search."""

    def __init__(self, blocks: CellBlocks, factors: Factors, scratch: Scratch, tolerance: float) -> None:
        self.blocks, self.scratch = blocks, scratch
        self.progress = Progress(tolerance)
        self.ready = {side: self._rows(factors, side, -1) for side in ("words", "docs")}
        self.progress.begin({side: gradient_square(*r) for side, r in self.ready.items()})

    def _rows(self, factors: Factors, side: str, turn: int):
        key = "word" if side == "words" else "doc_id"
        mine, other = (
            (factors.words, factors.docs) if side == "words" else (factors.docs, factors.words)
        )
        sums = _products(self.blocks, factors, side, self.scratch)
        rows = self.scratch.slot(step_rows(mine, sums, key, factors.k), f"{side}-rows", turn)
        return rows, gram(other, "f", factors.k)

    def renewed(self, factors: Factors, side: str, turn: int) -> DataFrame:
        # at the start both sides' rows are known; the second side's go stale with the first step
        rows = self.ready.pop(side, None) if turn == 0 and side == "words" else None
        rows, g = rows or self._rows(factors, side, turn)
        return descended(rows, "word" if side == "words" else "doc_id", g, side, self.progress)


def _half_step(
    blocks: CellBlocks, factors: Factors, side: str, update, shared: bool, scratch: Scratch
) -> DataFrame:
    """The renewed factor of one side (``words`` or ``docs``)."""
    k = factors.k
    key = "word" if side == "words" else "doc_id"
    mine = factors.words if side == "words" else factors.docs
    other = factors.docs if side == "words" else factors.words
    if shared:
        a = factors.words.withColumnRenamed("f", "a")
        b = factors.docs.withColumnRenamed("f", "b")
        sums = scratch.settled(blocks.share_sums(a, b, k, key), f"{side}-sums", k > UNROLL)
        sums = sums.select(key, build(k, lambda z: f"s[{z}] / {blocks.total!r}D").alias("s"))
    else:
        sums = _products(blocks, factors, side, scratch)
    # rows without a cell (documents without a counted word) have sums of zero
    rows = step_rows(mine, sums, key, k)
    if shared:
        shares = build(k, lambda z: f"greatest(s[{z}] / greatest(m[{z}], {TINY!r}D), {TINY!r}D)")
        mass = column_sums(other, "f", k).scalar()
        return rows.withColumn("m", mass).select(key, shares.alias("f"))
    g = gram(other, "f", k)
    return map_rows(rows, key, ["f", "s"], lambda f, s: update(f, s, g), "f")


def fit_nmf(
    blocks: CellBlocks,
    k: int,
    n_iter: int,
    method: str = "sklearn",
    metric: str = "kullback-leibler",
    start: Factors | None = None,
    corpus: DataFrame | None = None,
    keep_history: bool = False,
    scratch: Scratch | None = None,
    tolerance: float = 1e-5,
) -> Factors:
    """Alternate half-steps for a number of iterations. ``Lin_PG`` ends earlier once the norm of
    the projected gradient falls below ``tolerance`` times that of the first gradient.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown method {method!r}; choose from {sorted(METHODS)}.")
    if metric not in METRICS:
        raise ValueError(f"Unknown metric {metric!r}; choose from {METRICS}.")
    scratch = scratch or Scratch(blocks.cells.sparkSession, "nmf")
    update, first = METHODS[method]
    if method == "sklearn" and metric == "frobenius":
        update = multiplicative_step
    order = ["words", "docs"] if first == "words" else ["docs", "words"]
    factors = start or start_factors(blocks, corpus, k, scratch)
    history = None
    projected = None
    if update == "projected" and n_iter:
        projected = _Projected(blocks, factors, scratch, tolerance)
    for turn in range(n_iter):
        for side in order:
            if projected:
                renewed = projected.renewed(factors, side, turn)
            else:
                renewed = _half_step(
                    blocks, factors, side, update, update == "divergence", scratch
                )
            renewed = scratch.slot(renewed, side, turn)
            words = renewed if side == "words" else factors.words
            docs = renewed if side == "docs" else factors.docs
            factors = Factors(words, docs, k)
        if keep_history:
            w = factors.words.withColumnRenamed("f", "a")
            row = residuals(blocks, w, factors.docs.withColumnRenamed("f", "b"), k)
            row = row.select(F.lit(method).alias("method"), F.lit(turn + 1).alias("iter"), "*")
            row = scratch.write(row, f"history/iter={turn + 1}").select(row.columns)
            history = row if history is None else history.unionByName(row)
        if projected and projected.progress.settled:
            break
    return Factors(factors.words, factors.docs, k, history)


def nmf_to_plsa(factors: Factors) -> TopicModel:
    """``P(w|z) = W / colsum``, ``P(d|z) = H / rowsum``, P(z) from their products."""
    k = factors.k
    w = column_sums(factors.words, "f", k).first()["m"]
    h = column_sums(factors.docs, "f", k).first()["m"]
    masses = [x * y for x, y in zip(w, h)]
    total = sum(masses)
    scratch = Scratch(factors.words.sparkSession, "plsa-from-factors")

    def divided(factor: DataFrame, key: str, by: list[float]) -> DataFrame:
        shares = build(k, lambda z: f"f[{z}] / m[{z}]")
        rows = factor.withColumn("m", literal(by)).select(key, shares.alias("p"))
        return scratch.settled(rows, key, k > UNROLL)

    return TopicModel(
        words=divided(factors.words, "word", w),
        docs=divided(factors.docs, "doc_id", h),
        topic_prior=[m / total for m in masses],
        history=factors.history,
    )


def compare_methods(
    blocks: CellBlocks,
    k: int,
    n_iter: int,
    methods: list[str],
    corpus: DataFrame | None = None,
) -> DataFrame:
    """``(method, iter, kl, frobenius, kkt_w, kkt_h)`` of several methods."""
    from topicweave.operators.plsa import fit_em

    table = None
    for method in methods:
        if method == "EM":
            fitted = fit_em(blocks, k, n_iter, corpus=corpus, keep_history=True)
        else:
            fitted = fit_nmf(blocks, k, n_iter, method, corpus=corpus, keep_history=True)
        rows = fitted.history
        table = rows if table is None else table.unionByName(rows)
    return table
