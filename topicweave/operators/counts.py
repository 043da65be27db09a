"""Word counts, the joint distribution and the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions.counted import counted_words
from topicweave.functions.text import counted_tokens
from topicweave.session import Scratch


def _run_lengths(tokens: Column) -> Column:
    """(word, n) for each distinct token of one document, from the sorted array."""

    def counts(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda w, i: F.when(
                    (i == 0) | (w != F.get(ordered, i - 1)),
                    F.struct(w.alias("word"), i.alias("at")),
                ),
            ),
            lambda start: start.isNotNull(),
        )
        return F.transform(F.array(starts), lambda s: lengths(s, ordered))[0]

    def lengths(starts: Column, ordered: Column) -> Column:
        return F.transform(
            starts,
            lambda s, j: F.struct(
                s["word"].alias("word"),
                (F.coalesce(F.get(starts, j + 1)["at"], F.size(ordered)) - s["at"])
                .cast("double")
                .alias("n"),
            ),
        )

    # one-element arrays bind the sorted tokens to a name: computed once per row
    return F.transform(F.array(F.sort_array(tokens)), counts)[0]


def word_counts(text: Column) -> Column:
    """Array of ``(word, n)`` of one text."""
    return _run_lengths(counted_tokens(text))


def term_counts(corpus: DataFrame, text: str = "edited_text") -> DataFrame:
    """Non-zero cells ``(word, doc_id, n)`` of the word x document counts.

    A document is one row, so its words are counted inside the row: no shuffle.
    """
    counted = corpus.select("doc_id", F.inline(word_counts(F.col(text))))
    return counted.select("word", "doc_id", "n")


def counted_cells(corpus: DataFrame) -> DataFrame:
    """:func:`term_counts` of ``edited_text``, or of ``full_text`` cleaned on the way."""
    if "edited_text" in corpus.columns:
        return term_counts(corpus)
    counted = corpus.select("doc_id", F.inline(counted_words(F.col("full_text"))))
    return counted.select("word", "doc_id", "n")


def joint_distribution(cells: DataFrame) -> DataFrame:
    """Cells with ``x = n / sum(n)``."""
    grand_total = cells.agg(F.sum("n")).scalar()
    return cells.select("word", "doc_id", (F.col("n") / grand_total).alias("x"))


def vocabulary(cells: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Distinct words with their alphabetical position ``word_id`` from 0.

    Words are range-partitioned and sorted once; a word's position is its place in
    its partition plus the sizes of the partitions before (one row per partition).
    """
    spark = cells.sparkSession
    scratch = scratch or Scratch(spark, "vocabulary")
    ordered = (
        cells.select("word")
        .distinct()
        .repartitionByRange("word")
        .sortWithinPartitions("word")
        .select(
            "word",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        )
    )
    ordered = scratch.write(ordered, "ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("part")
        .count()
        .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    # one row per partition of `ordered`
    placed = ordered.join(F.broadcast(offsets), "part")
    return placed.select((F.col("first") + F.col("place")).alias("word_id"), "word")


def query_membership(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Vocabulary words with 1.0 where the query has the word, else 1e-12."""
    wanted = terms.select("word").distinct().withColumn("matched", F.lit(True))
    weight = F.when(F.col("matched"), F.lit(1.0)).otherwise(F.lit(1e-12))
    return vocab.join(wanted, "word", "left").select("word", weight.alias("n"))
