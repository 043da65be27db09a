"""The fitted model: a value object of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import build, dot, literal
from topicweave.operators.cells import CellBlocks


@dataclass(frozen=True)
class TopicModel:
    """P(w|z), P(d|z) and P(z) of a fitted model.

    words: ``word, p array<double>``; docs: ``doc_id, p array<double>``;
    topic_prior: P(z) as K numbers; history: residuals per iteration, if asked for.
    """

    words: DataFrame
    docs: DataFrame
    topic_prior: list[float]
    history: DataFrame | None = None

    @property
    def k(self) -> int:
        return len(self.topic_prior)

    @property
    def topics(self) -> DataFrame:
        """``(z, p)``"""
        one = self.words.sparkSession.range(1)
        return one.select(F.posexplode(literal(self.topic_prior)).alias("z", "p"))

    @property
    def weighted_words(self) -> DataFrame:
        """``(word, a)`` with ``a[z] = P(z) P(w|z)``"""
        return self.floored_words(0.0)

    def floored_words(self, floor: float) -> DataFrame:
        """:attr:`weighted_words` with P(w|z) raised to a floor."""
        weighted = build(self.k, lambda z: f"greatest(p[{z}], {floor!r}D) * prior[{z}]")
        words = self.words.withColumn("prior", literal(self.topic_prior))
        return words.select("word", weighted.alias("a"))

    def with_cells(self, cells) -> DataFrame:
        """Cells ``word, doc_id`` with ``a`` and ``b`` of their word and document: joined on word,
        then document.
        """
        docs = self.docs.select("doc_id", F.col("p").alias("b"))
        return cells.select("word", "doc_id").join(self.weighted_words, "word").join(docs, "doc_id")

    def reconstruct(self, cells) -> DataFrame:
        """``sum_z P(z) P(w|z) P(d|z)`` on the cells asked for: a frame ``word, doc_id``, or placed
        cells (``CellBlocks``), which stay where they are.
        """
        if isinstance(cells, CellBlocks):
            docs = self.docs.select("doc_id", F.col("p").alias("b"))
            return cells.values(self.weighted_words, docs, self.k, False)
        joined = self.with_cells(cells)
        return joined.select("word", "doc_id", F.expr(dot("a", "b", self.k)).alias("p"))
