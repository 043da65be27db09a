"""The newest statuses of every account, kept up to date by a stream.

The state of an account is the ids of its newest n statuses and nothing else. A status is passed
on when it enters them, so one that comes again, in a replayed or overlapping page, is either
among the ids or older than all of them and is dropped, however late it comes. What was passed
on and has since been overtaken stays in the target; :func:`newest` leaves it out when reading.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from topicweave.sources.corpus import latest_per_account, statuses_to_corpus, with_edited_text, with_timestamp
from topicweave.schemas import STATUS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of an account's state, by hash of the id: a very busy account is spread over so many
#: tasks, and keeps n ids in each.
PARTS = 8

_ROW = "doc_id long, created_at string, full_text string, screen_name string"
_STATE = "ids array<long>"


def entering(held: list[int], new: list[int], n: int) -> tuple[list[int], set[int]]:
    """The newest n of both, newest first, and which of ``new`` are among them."""
    kept = sorted({*held, *new}, reverse=True)[:n]
    return kept, set(kept) - set(held)


def newest_stream(
    statuses: DataFrame, n: int = 200, parts: int = PARTS, keep_days: float | None = None
) -> DataFrame:
    """Corpus rows of a stream that are among the newest n of their account when they come.

    ``keep_days`` lets go the state of an account whose last status is so much older than the
    newest status of the stream (by ``created_at``); if an old page is replayed after that, its
    rows come again and :func:`newest` keeps one of each.
    """
    milliseconds = None if keep_days is None else int(keep_days * 86_400_000)

    def update(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        last = 0
        for frame in frames:
            held, fresh = entering(held, frame["doc_id"].tolist(), n)
            own = frame[frame["doc_id"].isin(fresh)].drop_duplicates("doc_id")
            if milliseconds is not None:
                stamps = frame["created_ts"].dropna()
                last = max([last, *(int(t.timestamp() * 1000) for t in stamps)])
            if len(own):
                yield own[["doc_id", "created_at", "full_text", "screen_name"]]
        state.update((held,))
        if milliseconds is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + milliseconds)

    corpus = with_timestamp(statuses_to_corpus(statuses)).where("doc_id is not null")
    timeout = GroupStateTimeout.NoTimeout
    if milliseconds is not None:
        corpus = corpus.withWatermark("created_ts", f"{milliseconds} milliseconds")
        timeout = GroupStateTimeout.EventTimeTimeout
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    grouped = corpus.withColumn("part", part).groupBy("screen_name", "part")
    return grouped.applyInPandasWithState(update, _ROW, _STATE, "append", timeout)


def read_status_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Statuses landing in a folder, as they stand in the dumps."""
    reader = spark.readStream.schema(STATUS)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.json(path)


def newest(spark: SparkSession, target: str, n: int = 200) -> DataFrame:
    """The newest n statuses of every account from what :func:`newest_stream` has written."""
    rows = spark.read.schema(_ROW).parquet(target)
    return with_edited_text(latest_per_account(rows.dropDuplicates(["doc_id"]), n))
