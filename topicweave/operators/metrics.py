"""Fit measures: divergence, Frobenius error and first-order residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import dot, literal, total
from topicweave.operators.cells import CellBlocks
from topicweave.operators.gram import gram
from topicweave.session import Scratch


def _sums_and_gram(factor: DataFrame, name: str, k: int) -> tuple[list[float], np.ndarray]:
    """Column sums and Gram matrix of a factor from one pass: a column of ones stands beside."""
    wide = factor.select(F.concat(name, F.array(F.lit(1.0))).alias("f"))
    both = gram(wide, "f", k + 1)
    return both[k, :k].tolist(), both[:k, :k]


def _first_order(factor: DataFrame, sums: DataFrame, other_sums: list[float], key: str, k: int) -> DataFrame:
    """``sum |min(f, grad)|`` with ``grad = other_sums - s`` per row of the factor; a row without
    a cell has s = 0.
    """
    none = F.array_repeat(F.lit(0.0), k)
    rows = factor.join(sums, key, "left").withColumn("s", F.coalesce("s", none))
    rows = rows.withColumn("m", literal(other_sums))
    gap = total(k, lambda z: f"abs(least(f[{z}], m[{z}] - s[{z}]))")
    return rows.agg(F.expr(f"sum({gap})").alias("residual"))


def residuals(
    blocks: CellBlocks, w: DataFrame, h: DataFrame, k: int, scratch: Scratch | None = None
) -> DataFrame:
    """One row ``(kl, frobenius, kkt_w, kkt_h)`` for factors of the joint distribution.

    ``w`` is ``(word, a)``, ``h`` is ``(doc_id, b)`` and ``a . b`` models
    ``x = n / total``. Only non-zero cells are read, once; the sums over all other cells
    follow from the column sums and the Gram matrices.
    """
    scratch = scratch or Scratch(blocks.cells.sparkSession, "residuals")
    sides = scratch.write(blocks.fit_sums(w, h, k), "sides", "side")
    w_sums, w_gram = _sums_and_gram(w, "a", k)
    h_sums, h_gram = _sums_and_gram(h, "b", k)
    by_word = sides.where("side = 'words'").select("word", "s")
    by_doc = sides.where("side = 'docs'").select("doc_id", "s")
    kkt_w = _first_order(w.select("word", F.col("a").alias("f")), by_word, h_sums, "word", k)
    kkt_h = _first_order(h.select("doc_id", F.col("b").alias("f")), by_doc, w_sums, "doc_id", k)
    inner = float((w_gram * h_gram).sum())
    all_cells = float(np.dot(w_sums, h_sums))
    names = ("log_part", "x", "square")
    parts = [F.sum(F.when(F.col("word") == name, F.col("s")[0])).alias(name) for name in names]
    return sides.where("side = 'measures'").agg(*parts).select(
        (F.col("log_part") - F.col("x") + F.lit(all_cells)).alias("kl"),
        F.sqrt(F.greatest(F.col("square") + F.lit(inner), F.lit(0.0))).alias("frobenius"),
        kkt_w.scalar().alias("kkt_w"),
        kkt_h.scalar().alias("kkt_h"),
    )


def log_likelihood(blocks: CellBlocks, w: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """``sum n ln(a . b)``: never falls over EM iterations (up to the floors)."""
    joined = blocks.joined(w, h, k)
    return joined.agg(F.expr(f"sum(n * ln({dot('a', 'b', k)}))").alias("log_likelihood"))
