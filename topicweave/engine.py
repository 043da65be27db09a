"""The topic engine: one object from corpus to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicweave.model import TopicModel
from topicweave.operators import report
from topicweave.operators.cells import CellBlocks, place_cells, place_corpus
from topicweave.operators.counts import joint_distribution, term_counts, vocabulary
from topicweave.operators.nmf import METHODS, Factors, fit_nmf, nmf_to_plsa
from topicweave.operators.plsa import fit_em
from topicweave.operators.search import search, search_batch
from topicweave.session import Scratch
from topicweave.sources.corpus import generate_corpus, read_corpus, with_edited_text, write_corpus


class TopicEngine:
    """Corpus, counts, models and search with defaults of 10 topics, 20 iterations."""

    def __init__(self, spark: SparkSession, corpus: DataFrame | None = None) -> None:
        self.spark = spark
        self.corpus: DataFrame | None = None
        self._blocks: CellBlocks | None = None
        if corpus is not None:
            self.set_corpus(corpus)

    def set_corpus(self, corpus: DataFrame) -> None:
        """Use a DataFrame ``doc_id, screen_name, full_text[, edited_text]``."""
        self.release()
        self.corpus = corpus if "edited_text" in corpus.columns else with_edited_text(corpus)

    def read_from_csv(self, path: str, sep: str = "\t", manifest: str | None = None) -> None:
        """Read a delimited corpus; ``manifest`` keeps ids stable while files are added."""
        self.set_corpus(read_corpus(self.spark, path, sep, manifest=manifest))

    def generate_corpus(
        self,
        statuses: DataFrame,
        accounts: list[str] | DataFrame,
        tweets_per_user: int = 200,
        corpus_path: str | None = None,
    ) -> None:
        """Build the corpus from landed statuses; optionally write it as well."""
        corpus = generate_corpus(statuses, accounts, tweets_per_user)
        if corpus_path:
            write_corpus(corpus, corpus_path)
        self.set_corpus(corpus)

    def get_corpus(self) -> DataFrame:
        if self.corpus is None:
            raise ValueError("No corpus: read or generate one first.")
        return self.corpus

    def generate_matrix(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Joint distribution, counts and vocabulary. The texts are cleaned and counted once."""
        cells = Scratch(self.spark, "matrix").write(term_counts(self.get_corpus()), "cells")
        return joint_distribution(cells), cells, vocabulary(cells)

    @property
    def blocks(self) -> CellBlocks:
        if self._blocks is None:
            self._blocks = place_corpus(self.get_corpus())
        return self._blocks

    def compute_probabilities(
        self,
        method: str = "EM",
        n_topics: int = 10,
        n_iters: int = 20,
        init: Factors | None = None,
        cells: DataFrame | None = None,
        metric: str = "kullback-leibler",
        keep_history: bool = False,
    ) -> TopicModel:
        """Fit a model by EM or by a factorisation method.

        ``init`` is a custom start (W, H); ``cells`` are alternative weights
        ``(word, doc_id, n)`` instead of the corpus counts.
        """
        if method != "EM" and method not in METHODS:
            raise ValueError(f"Unknown method {method!r}: EM or one of {sorted(METHODS)}.")
        if n_topics <= 0 or n_iters <= 0:
            raise ValueError("Topics and iterations must be positive.")
        given = place_cells(cells) if cells is not None else None
        blocks = given or self.blocks
        corpus = self.get_corpus()
        if method == "EM":
            start = nmf_to_plsa(init) if init else None
            model = fit_em(blocks, n_topics, n_iters, start, corpus, keep_history)
        else:
            model = nmf_to_plsa(
                fit_nmf(blocks, n_topics, n_iters, method, metric, init, corpus, keep_history)
            )
        if given:
            given.release()
        return model

    def search(self, query: str, model: TopicModel, **options) -> DataFrame:
        return search(model, self.get_corpus(), query, **options)

    def search_batch(self, queries: DataFrame, model: TopicModel, **options) -> DataFrame:
        return search_batch(model, self.get_corpus(), queries, **options)

    def top_words(self, model: TopicModel, n_top_words: int = 10) -> DataFrame:
        return report.top_words(model.words, n_top_words)

    def topic_summary(self, model: TopicModel, n_top_words: int = 10) -> DataFrame:
        return report.topic_summary(model.words, n_top_words)

    def top_docs(self, model: TopicModel, n_topic: int = 0, n_top_docs: int = 5) -> DataFrame:
        return report.top_docs(model, self.get_corpus(), n_topic, n_top_docs)

    def release(self) -> None:
        """Give back the stored cells."""
        if self._blocks is not None:
            self._blocks.release()
            self._blocks = None
