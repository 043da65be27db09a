"""Reports on a fitted model: top words, top documents, dominant topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.model import TopicModel
from topicweave.operators.factors import as_long
from topicweave.operators.ranking import top_per_group


def _scored(factor: DataFrame, key: str) -> DataFrame:
    """Long form with the value rounded to the digits ranking relies on."""
    return as_long(factor, key).withColumn("p", F.round("p", 9))


def top_words(words: DataFrame, n_top_words: int = 10) -> DataFrame:
    """``(z, rank, word, p)``: the n most likely words of every topic."""
    if words is None:
        raise ValueError("There is no model to list words of.")
    if n_top_words <= 0:
        raise ValueError("Ask for one word per topic or more.")
    ranked = top_per_group(_scored(words, "word"), ["z"], [F.desc("p"), F.asc("word")], n_top_words)
    return ranked.select("z", "rank", "word", "p")


def topic_summary(words: DataFrame, n_top_words: int = 10) -> DataFrame:
    """``(z, summary)`` with lines like ``Topic #0: w1 w2 ...``; at most n words each."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))
    line = F.concat(
        F.lit("Topic #"),
        F.col("z").cast("string"),
        F.lit(": "),
        F.array_join(F.transform(ranked, lambda x: x["word"]), " "),
    )
    return top_words(words, n_top_words).groupBy("z").agg(line.alias("summary"))


def top_docs(
    model: TopicModel, corpus: DataFrame, n_topic: int | None = None, n_top_docs: int = 5
) -> DataFrame:
    """``(z, rank, doc_id, p, screen_name, full_text)`` of one topic or of all."""
    if n_topic is not None:
        one = model.docs.select("doc_id", F.lit(n_topic).alias("z"), F.col("p")[n_topic].alias("p"))
        scored = one.withColumn("p", F.round("p", 9))
    else:
        scored = _scored(model.docs, "doc_id")
    ranked = top_per_group(scored, ["z"], [F.desc("p"), F.asc("doc_id")], n_top_docs)
    return with_documents(ranked, corpus, n_top_docs * model.k).select(
        "z", "rank", "doc_id", "p", "screen_name", "full_text"
    )


#: Up to so many hits are looked up by their ids; up to more they are sent to the corpus.
LOOKED_UP, SENT = 1_000, 100_000


def with_documents(hits: DataFrame, corpus: DataFrame, at_most: int) -> DataFrame:
    """Look up the document of each hit.

    The ids of few hits go into the scan, which then skips the files and row groups without
    them; more hits are sent to the scan, and beyond that both sides are joined.
    """
    wanted = corpus.select("doc_id", "screen_name", "full_text")
    if at_most <= LOOKED_UP:
        rows = hits.collect()  # at_most rows
        found = hits.sparkSession.createDataFrame(rows, hits.schema)
        ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
        return wanted.where(F.col("doc_id").isin(ids)).join(F.broadcast(found), "doc_id")
    if at_most <= SENT:
        return wanted.join(F.broadcast(hits), "doc_id")
    return hits.join(wanted, "doc_id")


def dominant_topic(docs: DataFrame) -> DataFrame:
    """``(doc_id, z, p)``: the topic with the largest P(d|z) of every document."""
    best = F.array_max(
        F.transform(F.col("p"), lambda p, z: F.struct(F.round(p, 9).alias("p"), (-z).alias("nz")))
    )
    return docs.select("doc_id", best.alias("best")).select(
        "doc_id", (-F.col("best.nz")).alias("z"), F.col("best.p").alias("p")
    )


def best_doc_per_topic(model: TopicModel, corpus: DataFrame) -> DataFrame:
    """``(z, doc_id, p, screen_name, full_text)``: one document per topic."""
    best = F.max(F.struct("p", (-F.col("doc_id")).alias("nid"))).alias("best")
    picked = _scored(model.docs, "doc_id").groupBy("z").agg(best)
    picked = picked.select("z", (-F.col("best.nid")).alias("doc_id"), F.col("best.p").alias("p"))
    return with_documents(picked, corpus, model.k).select(
        "z", "doc_id", "p", "screen_name", "full_text"
    )
