"""Abbreviations of a corpus, found without a trained model.

A full stop after a word ends a sentence unless the word is an abbreviation. Abbreviations
stand with their full stop nearly always, are short, and may hold more full stops. The measure
is that of Kiss and Strunk (2006): the log-likelihood ratio of "nearly always with a full stop"
against "as often as any word", weighed by length, inner full stops and the times without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.text import WHITE_SPACE, as_text

#: Fixed values of the measure: how often an abbreviation has its full stop, and the least score.
ALWAYS = 0.99
LEAST_SCORE = 0.3
#: Marks that stand around words.
AROUND = r"^[(\[{<\"'“‘«¿¡]+|[)\]}>\"'”’»,;:!?]+$"
#: The most abbreviations that go into an expression over texts.
MOST = 10_000


def word_stops(corpus: DataFrame, text: str = "full_text") -> DataFrame:
    """``word, stops, plain``: how often each word stands with a full stop and without.

    Words are lower-cased and have a letter; the texts are read once and counts are combined
    before they move.
    """
    words = corpus.select(F.explode(F.split(as_text(F.col(text)), WHITE_SPACE)).alias("raw"))
    bare = words.select(F.lower(F.regexp_replace("raw", AROUND, "")).alias("bare"))
    stopped = F.col("bare").endswith(".") & ~F.col("bare").endswith("..")
    word = F.when(stopped, F.expr("left(bare, length(bare) - 1)")).otherwise(F.col("bare"))
    rows = bare.where(F.col("bare").rlike(r"\p{L}")).select(word.alias("word"), stopped.cast("long").alias("stop"))
    return rows.groupBy("word").agg(F.sum("stop").alias("stops"), F.sum(1 - F.col("stop")).alias("plain"))


def abbreviations(
    corpus: DataFrame, text: str = "full_text", least: float = LEAST_SCORE
) -> DataFrame:
    """``word, stops, plain, score`` of the abbreviations (without their last full stop)."""
    counts = word_stops(corpus, text)
    totals = counts.agg(F.sum("stops").alias("b"), F.sum(F.col("stops") + F.col("plain")).alias("n"))
    share = totals.select(F.least(F.col("b") / F.col("n"), F.lit(1 - 1e-9))).scalar()
    found = counts.where("stops > 0").withColumn("p", share)
    as_any = F.col("stops") * F.log("p") + F.col("plain") * F.log(1 - F.col("p"))
    always = F.col("stops") * F.log(F.lit(ALWAYS)) + F.col("plain") * F.log(F.lit(1 - ALWAYS))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = 2 * (always - as_any) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("plain"))
    return found.select("word", "stops", "plain", score.alias("score")).where(F.col("score") >= least)


def listed(found: DataFrame) -> list[str]:
    """The best abbreviations as a list for :func:`topicweave.functions.text.clean_text`."""
    rows = found.orderBy(F.desc("score"), "word").limit(MOST).collect()  # at most MOST
    return [r["word"] for r in rows]
