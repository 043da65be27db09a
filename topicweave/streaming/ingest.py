"""Structured Streaming ingest of landed status dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicweave.schemas import STATUS
from topicweave.sources.corpus import statuses_to_corpus, with_edited_text, with_timestamp


def stream_statuses(
    spark: SparkSession, path: str, late_by: str | None = None
) -> DataFrame:
    """Cleaned corpus rows from a landing folder, every id once.

    Without ``late_by`` every id is remembered: exact over any replay. With it (for
    example ``"2 days"``) ids are remembered only that long after the newest
    ``created_at``, which bounds the state for an endless stream.
    """
    raw = spark.readStream.schema(STATUS).json(path)
    corpus = with_timestamp(statuses_to_corpus(raw))
    if late_by is None:
        corpus = corpus.dropDuplicates(["doc_id"])
    else:
        corpus = corpus.withWatermark("created_ts", late_by)
        corpus = corpus.dropDuplicatesWithinWatermark(["doc_id"])
    return with_edited_text(corpus).select(
        "doc_id", "created_at", "full_text", "screen_name", "edited_text"
    )


def start_ingest(
    corpus_stream: DataFrame, target: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append the stream to a parquet corpus; restarts go on where they stopped."""
    writer = corpus_stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def land_statuses(corpus: DataFrame, path: str) -> None:
    """Write corpus rows as JSON status dumps, as a landing folder holds them."""
    corpus.select(
        F.col("doc_id").alias("id"),
        "created_at",
        "full_text",
        F.struct("screen_name").alias("user"),
    ).write.mode("append").json(path)
