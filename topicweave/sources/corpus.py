"""Reading corpora and status dumps, and writing corpora and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.functions.text import as_text, clean_text
from topicweave.operators.ranking import top_per_group
from topicweave.schemas import CORPUS_COLUMNS, CORPUS_FILE, CREATED_AT_FORMAT, STATUS
from topicweave.session import Scratch


#: Up to so many file blocks their first numbers are sent to the rows.
SENT_BLOCKS = 100_000


def _numbered_blocks(blocks: DataFrame, known: DataFrame | None) -> DataFrame:
    """``file, block, first``: where the ids of each block of a file begin.

    Files of ``known`` (``file, first, rows``) keep their place; others follow by path. A known
    file whose rows have changed can't keep it.
    """
    files = blocks.groupBy("file").agg(F.sum("rows").alias("rows"))
    if known is None:
        placed, end = None, F.lit(0)
    else:
        old = known.select("file", F.col("first").alias("at"), F.col("rows").alias("were"))
        both = files.join(old, "file").persist()
        changed = both.where("rows <> were").select("file").first()
        if changed:
            raise ValueError(f"{changed['file']} has other rows than when it was numbered.")
        placed = both.select("file", "at")
        files = files.join(old, "file", "left_anti")
        end = F.lit(known.agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0)
    # one row per file or block, not per line
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    fresh = files.select("file", (end + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("at"))
    starts = fresh if placed is None else placed.unionByName(fresh)
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .join(starts, "file")
        .select("file", "block", "least", "rows", "at", (F.col("at") + F.col("before")).alias("first"))
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    scratch: Scratch | None = None,
    manifest: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read a delimited corpus with header; texts may be quoted and span lines.

    Rows of a file have no key, so each gets a ``doc_id``: gapless from 0, by file path and
    place inside the file, however Spark packs files into tasks. ``manifest`` names a folder
    that keeps the files' numbers: files read before keep their ids when others are added, and
    new files follow. Without ``multi_line`` large files are read in pieces by several tasks
    (texts then hold no line breaks). The rows are written once with their ids.
    """
    scratch = scratch or Scratch(spark, "corpus")
    rows = spark.read.schema(CORPUS_FILE).csv(
        path, sep=sep, header=True, multiLine=multi_line, quote='"', escape='"'
    )
    # a block of a file is read by one task in order, so its rows are consecutive there
    rows = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = scratch.write(rows, "rows")
    blocks = rows.groupBy(F.col("_file").alias("file"), F.col("_block").alias("block")).agg(
        F.count("*").alias("rows"), F.min("_at").alias("least")
    )
    kept = _kept_files(spark, manifest) if manifest else None
    places = scratch.write(_numbered_blocks(blocks, kept), "places")
    if manifest:
        files = places.groupBy("file").agg(F.min("at").alias("first"), F.sum("rows").alias("rows"))
        if kept is not None:
            files = files.join(kept.select("file"), "file", "left_anti")
        files.write.mode("append").parquet(manifest)
    places = places.select("file", "block", "least", "first")
    if places.count() <= SENT_BLOCKS:
        places = F.broadcast(places)
    on = (F.col("_file") == F.col("file")) & (F.col("_block") == F.col("block"))
    doc_id = F.col("first") + F.col("_at") - F.col("least")
    return rows.join(places, on).select(doc_id.alias("doc_id"), *CORPUS_FILE.fieldNames())


def _kept_files(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The files numbered so far, if any."""
    try:
        return spark.read.schema("file string, first long, rows long").parquet(manifest)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Read landed JSON status dumps; overlapping pages repeat ids, kept once."""
    return spark.read.schema(STATUS).json(path).dropDuplicates(["id"])


def union_statuses(dumps: list[DataFrame]) -> DataFrame:
    """All rows of several dumps (bag union)."""
    return reduce(lambda a, b: a.unionByName(b), dumps)


def keep_accounts(statuses: DataFrame, accounts: list[str] | DataFrame) -> DataFrame:
    """Rows of the listed accounts: a list, or a table with ``screen_name``."""
    if isinstance(accounts, DataFrame):
        return statuses.join(accounts.select("screen_name"), "screen_name", "left_semi")
    return statuses.where(F.col("screen_name").isin(list(accounts)))


def latest_per_account(statuses: DataFrame, n: int = 200) -> DataFrame:
    """The newest n rows (largest ids) of every account."""
    return top_per_group(statuses, ["screen_name"], [F.desc("doc_id")], n).drop("rank")


def statuses_to_corpus(statuses: DataFrame) -> DataFrame:
    """Status records as ``doc_id, created_at, full_text, screen_name``."""
    return statuses.select(
        F.col("id").alias("doc_id"),
        "created_at",
        "full_text",
        F.col("user.screen_name").alias("screen_name"),
    )


def spread(corpus: DataFrame) -> DataFrame:
    """Give every core texts to work on when a small source has few input splits.

    Large sources have more splits than cores and stay as they are.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    if corpus.rdd.getNumPartitions() >= cores:
        return corpus
    return corpus.repartition(4 * cores, "doc_id")


def with_edited_text(corpus: DataFrame, abbreviations: Sequence[str] = ()) -> DataFrame:
    """Add the cleaned text; listed abbreviations keep their full stop."""
    return corpus.withColumn("edited_text", clean_text(F.col("full_text"), abbreviations))


def with_timestamp(corpus: DataFrame) -> DataFrame:
    """Add ``created_ts``, parsed from ``created_at`` (null where it does not parse)."""
    parsed = F.try_to_timestamp(F.substring("created_at", 5, 100), F.lit(CREATED_AT_FORMAT))
    return corpus.withColumn("created_ts", parsed)


def text_column(corpus: DataFrame) -> DataFrame:
    """``(doc_id, edited_text)``; a missing text is empty."""
    return corpus.select("doc_id", as_text(F.col("edited_text")).alias("edited_text"))


def generate_corpus(
    statuses: DataFrame, accounts: list[str] | DataFrame, tweets_per_user: int = 200
) -> DataFrame:
    """Corpus of the newest statuses of the listed accounts, with cleaned text."""
    rows = keep_accounts(statuses_to_corpus(statuses), accounts).dropDuplicates(["doc_id"])
    return with_edited_text(latest_per_account(rows, tweets_per_user)).select(*CORPUS_COLUMNS)


def write_corpus(corpus: DataFrame, path: str, sep: str = "\t") -> None:
    """Write the four corpus columns, delimited, with header."""
    corpus.select(*CORPUS_FILE.fieldNames()).write.mode("overwrite").csv(
        path,
        sep=sep,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """Write one text line per topic, all topics, in topic order."""
    if not isinstance(path, str):
        raise ValueError("The route must be a string.")
    lines = summary.orderBy("z").select(F.col("summary").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
