"""Line dedup by hash: native DataFrame operations only.

A document's distinct keys (lines stripped and A-Z lower-cased, long enough) become rows
(hash, document, positions). The rows are range-partitioned by hash, and by a spread of
the documents so that a line in a third of all documents is many groups, and sorted inside a
group by document: the first row of a group streams out as its first occurrence, with the
group's number of documents. First occurrences are summed per hash; hashes in at least
``min_docs`` documents keep their lines only in the largest ``doc_id``. Decisions return as
bitmaps per document (a map from word number to 64 bits, words without a dropped line left
out); texts are read again only by :func:`apply_bitmaps`.

A null or empty text is one empty line. Rows with equal ``doc_id`` count as one document
where documents are counted; if the id is the largest holding a line, all such rows keep it.
A null ``doc_id`` is smaller than any other. An empty table gives no rows. Rows are told
apart by id and text, so extra columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm.common import sealed, shuffle_partitions
from topicweave.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def text_key(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"_ta": F.xxhash64("text"), "_tb": F.xxhash64(F.lit(1), F.col("text"))}
    )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, spread: int = 64
) -> DataFrame:
    """``doc_id, _ta, _tb, dropped``: bitmaps of the lines to drop, for documents with any."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = (
        text_key(docs.select("doc_id", "text"))
        .select("doc_id", "_ta", "_tb", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select(
            "doc_id", "_ta", "_tb", "pos",
            F.xxhash64("key").alias("ha"), F.xxhash64(F.lit(1), F.col("key")).alias("hb"),
        )
    )
    lines = scratch.write(lines, "lines")

    group = ["ha", "hb", "part"]
    dealt = lines.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).repartitionByRange(
        shuffle_partitions(docs.sparkSession), *group
    )
    ordered = Window.partitionBy(*group).orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    streamed = dealt.withColumns(
        {"nth": F.row_number().over(ordered), "before": F.lag("doc_id").over(ordered)}
    ).withColumn("opens", (F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("doc_id")))
    # One row per document of a group; a later one only adds to the count.
    found = (
        streamed.where("opens")
        .groupBy("ha", "hb")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        .where(F.col("n_docs") >= min_docs)
    )
    found = scratch.write(found, "found")  # so the join below can split a hot line
    dropped = (
        lines.join(found, ["ha", "hb"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy("doc_id", "_ta", "_tb", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
        .groupBy("doc_id", "_ta", "_tb")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )
    return dropped


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_lines``, ``n_lines`` and ``n_dropped`` (such columns are replaced)."""
    results = ["kept_lines", "n_lines", "n_dropped"]
    docs, names, columns = sealed(docs, ["doc_id", "text"], results)
    marks = bitmaps.select(
        F.col("doc_id").alias("_doc"), F.col("_ta").alias("_ma"), F.col("_tb").alias("_mb"),
        F.col("dropped").alias("_dropped"),
    )
    keyed = text_key(docs)
    joined = keyed.join(
        marks,
        keyed["doc_id"].eqNullSafe(marks["_doc"])
        & (keyed["_ta"] == marks["_ma"])
        & (keyed["_tb"] == marks["_mb"]),
        "left",
    )
    lines = split_lines(F.col("text"))

    def stays(_line: Column, at: Column) -> Column:
        bits = F.element_at("_dropped", F.shiftright(at, 6))
        # getbit needs 0..63; a word that is absent drops nothing
        return F.coalesce(F.getbit(bits, at.bitwiseAND(F.lit(63))) == 0, F.lit(True))

    kept = F.when(F.col("_dropped").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("kept_lines", kept)
    return out.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": (F.size(lines) - F.size("kept_lines")).cast("long"),
        }
    ).select(*names, *results).toDF(*columns, *results)
