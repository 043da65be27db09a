"""Word counts that grow page by page, without counting anything twice.

A store is a folder of small tables, one part per page: the cells of the page's new documents,
their ids, the page's words with their sums, and its total. A page is written whole before its
total, and only pages with a total are read, so a page that was cut short is simply written
again. Sums of words are merged level by level: when a level holds enough parts they become one
part of the next, so a word's sum is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicweave.operators.counts import counted_cells, vocabulary

#: Parts of a level that become one part of the next.
FAN = 4
#: Up to so many ids of a page are sent to the stored ids, instead of moving those.
SENT_IDS = 500_000

_TABLES = {
    "cells": "word string, doc_id long, n double, page long",
    "ids": "doc_id long, page long",
    "words": "word string, n double, docs long, level int, first long, page long",
    "totals": "n double, cells long, docs long, page long",
}


class CountStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, table: str) -> DataFrame:
        schema = _TABLES[table]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, *parts: str) -> None:
        rows.write.mode("overwrite").parquet("/".join([self.path, table, *parts]))

    @property
    def pages(self) -> list[int]:
        """Numbers of the complete pages; one small row each."""
        return sorted(r["page"] for r in self._read("totals").select("page").distinct().collect())

    def _complete(self, table: str) -> DataFrame:
        return self._read(table).where(F.col("page").isin(self.pages))

    def add(self, corpus: DataFrame, page: int) -> None:
        """Count the documents of a page that no earlier page held.

        ``corpus`` has ``doc_id`` and ``edited_text`` or ``full_text``; a document that is
        repeated inside the page counts once. A page that is complete is not counted again.
        """
        done = self.pages
        if page in done:
            return
        text = "edited_text" if "edited_text" in corpus.columns else "full_text"
        rows = corpus.select("doc_id", text).dropDuplicates(["doc_id"])
        rows = rows.where("doc_id is not null").persist()
        span = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        if done and span["n"]:
            # ids of statuses rise, so few stored files overlap the page's span
            known = self._complete("ids").where(F.col("doc_id").between(span["a"], span["b"]))
            if span["n"] <= SENT_IDS:
                known = known.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")
            fresh = rows.join(known.select("doc_id"), "doc_id", "left_anti")
        else:
            fresh = rows
        part = f"page={page}"
        self._write(counted_cells(fresh), "cells", part)
        self._write(fresh.select("doc_id"), "ids", part)
        cells = self.spark.read.parquet(f"{self.path}/cells/{part}")
        sums = cells.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
        self._write(sums, "words", "level=0", f"first={page}", part)
        total = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.count("*").alias("cells"))
        total = total.withColumn("docs", F.lit(self.spark.read.parquet(f"{self.path}/ids/{part}").count()))
        rows.unpersist()
        self._write(total.coalesce(1), "totals", part)
        self._merge()

    def _live(self) -> list[tuple[int, int, int]]:
        """(level, first page, last page) of the word parts that no other part contains."""
        parts = self._complete("words").select("level", "first", "page").distinct().collect()
        found: list[tuple[int, int, int]] = []
        for level, first, last in sorted(map(tuple, parts), reverse=True):
            if not any(a <= first and last <= b for _, a, b in found):
                found.append((level, first, last))
        return sorted(found, key=lambda p: p[1])

    def _merge(self) -> None:
        """Make one part of the next level wherever enough neighbours of a level stand."""
        while True:
            live = self._live()
            for i in range(len(live) - FAN + 1):
                run = live[i : i + FAN]
                if len({p[0] for p in run}) == 1:
                    level, first, last = run[0][0], run[0][1], run[-1][2]
                    rows = self._words(run).groupBy("word").agg(
                        F.sum("n").alias("n"), F.sum("docs").alias("docs")
                    )
                    self._write(rows, "words", f"level={level + 1}", f"first={first}", f"page={last}")
                    break
            else:
                return

    def _words(self, parts: list[tuple[int, int, int]]) -> DataFrame:
        rows = self._read("words")
        wanted = F.lit(False)
        for level, first, last in parts:
            wanted = wanted | ((F.col("level") == level) & (F.col("first") == first) & (F.col("page") == last))
        return rows.where(wanted)

    @property
    def cells(self) -> DataFrame:
        """``(word, doc_id, n)`` of all complete pages."""
        return self._complete("cells").select("word", "doc_id", "n")

    def totals(self) -> DataFrame:
        """One row ``(n, cells, docs)``."""
        return self._read("totals").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "cells", "docs")]
        )

    def words(self) -> DataFrame:
        """``(word, n, docs)``: occurrences of each word and documents that hold it."""
        rows = self._words(self._live())
        return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    def vocabulary(self) -> DataFrame:
        """``(word_id, word)`` from the merged words; the cells are not read."""
        return vocabulary(self.words().select("word"))

    def joint_distribution(self) -> DataFrame:
        """Cells with ``x = n / total``; the total is a sum of one row per page."""
        total = self.totals().select("n").scalar()
        return self.cells.select("word", "doc_id", (F.col("n") / total).alias("x"))


def start_counting(
    corpus_stream: DataFrame, store: CountStore, checkpoint: str, after: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Count a stream of corpus rows; each batch is a page, counted once even if it is repeated
    after a failure."""

    def add(batch: DataFrame, page: int) -> None:
        store.add(batch, page)
        if after:
            after(page)

    writer = corpus_stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
